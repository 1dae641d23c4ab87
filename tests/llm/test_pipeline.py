"""The pipeline's stages against brute-force versions, each on what the stage before it kept."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from loomgrid.llm import linededup, toxicity
from loomgrid.llm.queries import tokenizer_path
from tests.llm.test_operators import jaccard, lower, rng_words, windows, words

TOXIC = ["vilest", "vilexa", "vilmor"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(21)
    path = tmp_path_factory.mktemp("sf")
    common = [" ".join(rng_words(rng, 8)) for _ in range(5)]
    items = [(i, " ".join(rng_words(rng, 14))) for i in range(5)]
    docs, labels = [], []
    for i in range(160):
        text = [" ".join(rng_words(rng, 30)) + "." for _ in range(3)]
        toxic = i % 5 == 0
        if toxic:
            text[1] = f"so {rng.choice(TOXIC)} it is {rng.choice(TOXIC)}."
        if i % 3 == 0:
            text.insert(0, rng.choice(common))
        if i % 11 == 0:
            text.append(f"{items[i % 5][1]} again")
        docs.append((i, "\n".join(text)))
        labels.append((i, 1, int(toxic)))
    for i in range(40):
        base = docs[4 * i + 1][1].replace("\n", " ").split(" ")
        base[i % len(base)] = "changed"
        docs.append((1000 + i, " ".join(base)))
    docs += [(1500 + i, docs[3 * i + 1][1]) for i in range(20)]  # copies that line dedup empties
    docs += [(2000, None), (2001, ""), (2002, " \n ")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def drop_lines(docs):
    key = lambda x: lower(x.strip(linededup.BLANKS))
    owners = defaultdict(set)
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                owners[key(x)].add(i)
    out = {}
    for i, t in docs.items():
        rows = (t or "").split("\n")
        kept = [x for x in rows if len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == i]
        if len(kept) == len(rows) or any(x.strip(linededup.BLANKS) for x in kept):
            out[i] = t if len(kept) == len(rows) else "\n".join(kept)
    return out


def drop_copies(docs):
    ids = sorted(docs)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if words(docs[i]) and words(docs[j]) and jaccard(docs[i], docs[j]) >= 0.8:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: docs[i] for i in ids if find(i) == i}


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    model = toxicity.fit(tables["documents"], tables["labels"])
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(tables["documents"], model).collect()}
    docs = {r["doc_id"]: r["text"] for r in tables["documents"].collect() if scores[r["doc_id"]] < 0.5}
    assert not any(i % 5 == 0 for i in docs if i < 160) and sum(i < 160 for i in docs) == 128
    assert len(drop_lines(docs)) <= len(docs) - 15
    docs = drop_copies(drop_lines(docs))
    bench = [w for r in tables["benchmark"].collect() for w in windows(r["text"])]

    def leaks(text):
        w = words(text)
        return any(tuple(w[k : k + len(b)]) == b for b in bench for k in range(len(w) - len(b) + 1))

    docs = {i: t for i, t in docs.items() if not leaks(t)}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in docs.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want[i, 0, 0, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))] += 1
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    assert len({r["sequence_id"] for r in found}) <= sum(r["length"] for r in found) // 2048 + 2


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, score double, items string, n_words int, class_id string"


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_odd_and_empty_tables_pass_the_pipeline(spark, tmp_path, rows):
    rest = ("en", "s", 1, 0.5, "x", 1, "y")
    long = "plain words of a very long text. " * 5000
    docs = [(None, "a row without an id", *rest), (1, None, *rest), (2, "", *rest), (3, long, *rest), (4, "same id", *rest), (4, "same id", *rest), (5, "é 😀", None, None, None, None, None, None, None)]
    spark.createDataFrame(docs if rows == "odd" else [], EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(3, None, 0), (None, 1, 1), (4, 1, 0), (99, 1, 1)] if rows == "odd" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "")] if rows == "odd" else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r["piece"] == 0)
    assert found == (Counter({None: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1}) if rows == "odd" else Counter())
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
