"""Nulls, empty and long texts, repeated rows, empty tables, and columns with clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import decontam, langid, licenses, linededup, neardup, packing, pii, quality, topk, toxicity
from loomgrid.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, drop int, term string, th string, class_id string, h int, keep string"
EXTRA = (0.5, "s", 1, "t", "u", "c", 2, "k")
LONG = "Lorem ipsum dolor sit amet consectetur. " * 3000
ROWS = [
    (1, "Some text here with a@b.org in it", "en", "a", 10, *EXTRA), (1, "Some text here with a@b.org in it", "en", "a", 10, *EXTRA), (1, "other text of the same id", "en", "a", 10, *EXTRA),
    (None, "no id at all in this row", None, None, None, *EXTRA), (2, None, "fr", None, 0, *EXTRA), (3, "", None, "b", 0, *EXTRA), (4, " \n \t\n", "en", "b", 4, *EXTRA), (5, LONG, "en", "b", len(LONG), *EXTRA),
    (6, LONG, "en", "b", len(LONG), *EXTRA), (7, "x" * 50_000, "de", "b", 50_000, *EXTRA), (8, "퟿� 😀 é", "en", None, 5, *EXTRA),
]


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, spark):
    return spark.createDataFrame(ROWS if request.param == "odd" else [], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 1), (1, 1, 0), (2, None, None), (3, 0, 0), (5, 1, 0), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "lorem ipsum dolor sit amet consectetur"), (2, None), (3, ""), (None, "text")], "item_id long, text string")


def whole(found, docs, added):
    """The operator returns every row and column, and its own."""
    rows = found.collect()
    assert len(rows) == docs.count()
    assert set(found.columns) == set(docs.columns) | set(added)
    return rows


def test_pii(docs):
    rows = whole(pii.with_spans(docs), docs, {"spans"})
    assert sum(s["kind"] == "email" for r in rows for s in r["spans"] if r["doc_id"] == 1) in (0, 2)
    pii.sanitise(docs).collect()


def test_licenses(docs):
    found = licenses.scan_licenses(docs)
    assert len(found.collect()) == docs.count() and {"n_candidates", "licenses", "source"} <= set(found.columns)


def test_line_dedup(docs):
    rows = whole(linededup.dedup_lines(docs), docs, {"n_lines", "n_dropped"})
    by_id = {r["doc_id"]: r for r in rows}
    if rows:
        assert by_id[6]["text"] == "" and by_id[6]["n_dropped"] == 1 and by_id[5]["n_dropped"] == 0 and by_id[2]["text"] is None and by_id[1]["n_dropped"] == 0


def test_near_duplicates(docs):
    rows = whole(neardup.near_duplicate_classes(docs), docs, {"class_id"})
    by_id = {r["doc_id"]: r["class_id"] for r in rows}
    if rows:
        assert by_id[6] == 5 and by_id[3] == 3 and by_id[None] is None
    kept = neardup.one_of_each_class(docs)
    assert kept.columns == docs.columns and kept.count() == max(0, docs.count() - 1)


def test_quality(docs, labels):
    rows = whole(quality.judge(docs, labels), docs, {"perplexity", "threshold", "keep"})
    assert all(r["keep"] for r in rows if r["doc_id"] in (2, 3))


def test_toxicity(docs, labels):
    rows = whole(toxicity.score(docs, toxicity.fit(docs, labels)), docs, {"score", "offending"})
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_without_labels(docs, labels):
    rows = toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert all(r["score"] < 0.5 for r in rows)


def test_decontamination(docs, benchmark):
    rows = whole(decontam.contamination(docs, benchmark), docs, {"n_words", "n_hit", "items", "near_items", "contaminated"})
    assert {r["doc_id"] for r in rows if r["contaminated"]} == ({5, 6} if rows else set())
    assert all(not r["contaminated"] for r in decontam.contamination(docs, benchmark.limit(0)).collect())


def test_packing(docs):
    rows = packing.pack(docs, tokenizer_path()).collect()
    assert sum(r["piece"] == 0 for r in rows) == docs.count()


def test_language(docs):
    rows = whole(langid.identify(docs, langid.prototypes(docs)), docs, {"lang_pred", "score"})
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (2, 3, 4))


def test_top_k(spark):
    schema = "vec_id long, embedding array<double>, score string, v int, norm int, bucket int"
    assert topk.top_k(spark.createDataFrame([], schema), F.lit(True)).collect() == []
    rows = [(0, [1.0, 2.0], "s", 1, 1, 1), (0, [1.0, 2.0], "s", 1, 1, 1), (None, [1.0, 1.0], "s", 1, 1, 1), (2, None, "s", 1, 1, 1), (3, [1.0, None], "s", 1, 1, 1), (4, [], "s", 1, 1, 1)]
    got = topk.top_k(spark.createDataFrame(rows, schema), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 4, 0)]


def test_workers_give_memory_back_after_a_task(monkeypatch):
    """A worker stays for later stages, so what it keeps after a task counts there as well."""
    import pyarrow as pa
    import pyspark

    from loomgrid.llm import _shared, tokens

    given = []
    monkeypatch.setattr(_shared, "give_back", lambda: given.append(1), raising=False)
    monkeypatch.setattr(pyspark.TaskContext, "get", classmethod(lambda cls: cls))
    monkeypatch.setattr(pyspark.TaskContext, "partitionId", classmethod(lambda cls: 0), raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["some words here", "more words"])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in packing._tokenise(tokenizer_path(), 2048)(iter([batch]))) == 2
    assert tokens.encoder(tokenizer_path()).size == 0 and given == [1]
