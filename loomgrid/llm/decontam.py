"""Benchmark decontamination by a positional inverted index. DataFrame operations only.

1. The corpus frequency of every benchmark term is counted over all documents.
2. Phrases are the distinct windows of the items (ten consecutive words, or a whole shorter item), so a passage that
   items share, or that an item repeats, is looked for once. The rarest terms of a phrase are its anchors.
3. The index stores the postings of these terms: document, term, position; and the length of every document. It is made
   in one pass over the texts and written to the shared folder; all that follows reads it.
4. A posting at position p of a term that a phrase has at offset q points to the start p - q. The lists of a phrase's
   anchors are intersected by meeting at one (document, phrase, start).
5. Exact phrases: where all anchors meet, the document's words are compared with the phrase, by two 64-bit hashes.
   Only documents with such a meeting are read again.
6. Proximity: where the PROXIMITY rarest terms of a phrase all stand within SLOP words more than its length, in any
   order. For this, an item's phrases that do not overlap are taken, and its last.

Rows are dealt by document, phrase and start (or a stretch of the document), never by a term, so a frequent word or
passage makes no large group. A posting makes a row for each phrase that its term anchors; phrases of repeated words
are few, as they are distinct. Terms are matched by a broadcast of the benchmark's terms while they are no more than
BROADCAST_TERMS, and by a shuffled join beyond that.

Defined results. Null and empty texts have no words and no hits. Rows are told apart by doc_id and text, so rows that
share a doc_id are judged each on its own text, and identical rows alike. Items without words match nothing; rows of
one item_id are several texts of that item; rows without an item_id do not count. Other columns pass through, but for
those that the result adds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm._shared import LOWER, UPPER, small, staged

#: Characters that stand between words: U+0000 to U+002F, U+003A to U+0060 but A-Z, U+007B to U+007F (fixed values).
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
WINDOW = 10
ANCHORS = 2
PROXIMITY = 3
SLOP = 5
BROADCAST_TERMS = 200_000


def words_of(text: Column) -> Column:
    """Runs of ASCII digits, letters (A-Z lowered) and characters beyond ASCII."""
    folded = F.translate(F.coalesce(text, F.lit("")), BETWEEN + UPPER, " " * len(BETWEEN) + LOWER)
    return F.array_remove(F.split(folded, " ", -1), "")


def _row_key() -> list[Column]:
    return [F.col("doc_id"), F.xxhash64("text").alias("th")]


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id and the words of one of its texts; items without words are left out."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    return rows.where((F.size("words") > 0) & F.col("item_id").isNotNull()).distinct()


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item_id, start, last, phrase (a hash), check (another) and words of every window."""
    of = F.size("words")
    starts = items.select("item_id", "words", F.greatest(F.lit(0), of - size).alias("last")).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("last"))))
    placed = starts.select("item_id", "start", "last", F.slice("words", F.col("start") + 1, F.lit(size)).alias("words"))
    return placed.withColumns({"phrase": F.xxhash64("words"), "check": F.xxhash64(F.lit("phrase"), "words")})


def term_counts(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """term, n: how often each of the terms occurs in all documents."""
    tokens = docs.select(F.explode(words_of(F.col("text"))).alias("term"))
    if n_terms <= BROADCAST_TERMS:
        found = tokens.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    else:
        found = tokens.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")
    return terms.join(found, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors_of(phrases: DataFrame, counts: DataFrame, most: int) -> DataFrame:
    """phrase, check, len, term, q (its first offset), k: the phrase's rarest terms, the rarest first, and n of them."""
    placed = phrases.select("phrase", "check", F.size("words").alias("len"), F.posexplode("words").alias("q", "term")).join(counts, "term")
    once = placed.groupBy("phrase", "check", "len", "term", "n").agg(F.min("q").alias("q"))
    ranked = once.groupBy("phrase", "check", "len").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "term", "q"))), 1, most).alias("ranked"))
    return ranked.select("phrase", "check", "len", F.size("ranked").alias("n"), F.posexplode("ranked").alias("k", "r")).select("phrase", "check", "len", "n", "k", "r.term", "r.q")


def index_of(docs: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """doc_id, th, term, pos: the postings of the terms, and a row of each document with the term '' and its number of words."""
    ended = F.concat(words_of(F.col("text")), F.array(F.lit("")))
    tokens = docs.select(*_row_key(), F.posexplode(ended).alias("pos", "term"))
    wanted = terms.unionByName(terms.sparkSession.createDataFrame([("",)], "term string"))
    return tokens.join(small(wanted, n_terms, BROADCAST_TERMS), "term").select("doc_id", "th", "term", "pos")


@dataclass
class Index:
    """The staged tables: windows of the items, those that proximity takes, anchors of exact phrases, terms of proximity, and the postings."""

    windows: DataFrame
    apart: DataFrame
    anchors: DataFrame
    near: DataFrame
    postings: DataFrame
    n_anchors: int

    @classmethod
    def build(cls, docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, anchors: int = ANCHORS, proximity: int = PROXIMITY) -> Index:
        windows = staged(windows_of(items_of(benchmark), size), "bench-windows")
        terms = staged(windows.select(F.explode("words").alias("term")).distinct(), "bench-terms")
        n_terms = terms.count()
        counts = staged(term_counts(docs, terms, n_terms), "bench-counts")
        rare = staged(anchors_of(windows.select("phrase", "check", "words").distinct(), counts, max(anchors, proximity)), "bench-anchors")
        exact = rare.where(F.col("k") < anchors).withColumn("n", F.least("n", F.lit(anchors)))
        apart = windows.where((F.col("start") % size == 0) | (F.col("start") == F.col("last")))
        near = rare.join(apart.select("phrase").distinct(), "phrase", "left_semi").where((F.col("k") < proximity) & (F.col("n") > 1)).withColumn("n", F.least("n", F.lit(proximity)))
        used = exact.select("term").union(near.select("term")).distinct()
        return cls(windows, apart, exact, near, staged(index_of(docs, used, n_terms), "bench-index"), rare.count())


def phrase_starts(index: Index) -> DataFrame:
    """doc_id, th, phrase, check, start, len: where all anchors of a phrase stand as in it."""
    lists = index.postings.join(small(index.anchors, index.n_anchors, BROADCAST_TERMS), "term")
    starts = lists.select("doc_id", "th", "phrase", "check", "len", "n", (F.col("pos") - F.col("q")).alias("start"), F.expr("shiftleft(1, k)").alias("bit"))
    meeting = starts.where("start >= 0").groupBy("doc_id", "th", "phrase", "check", "len", "n", "start").agg(F.bit_or("bit").alias("met"))
    return meeting.where("met = shiftleft(1, n) - 1").drop("met", "n")


def phrase_matches(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, th, phrase, start, length: every occurrence of a window as an exact phrase (start: the word's number)."""
    candidates = staged(phrase_starts(index), "bench-starts")
    keys = staged(candidates.select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).distinct(), "bench-holders")
    rows = docs.select(*_row_key(), "text")
    on = [rows["doc_id"].eqNullSafe(F.col("__doc")), rows["th"] == F.col("__th")]
    texts = rows.join(small(keys, keys.count(), BROADCAST_TERMS), on, "left_semi").dropDuplicates(["doc_id", "th"])
    own = candidates.groupBy(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).agg(F.collect_set(F.struct("start", "len", "phrase", "check")).alias("candidates"))
    both = texts.join(own.hint("shuffle_hash"), [texts["doc_id"].eqNullSafe(F.col("__doc")), texts["th"] == F.col("__th")])

    def exact(words: Column) -> Column:
        part = lambda c: F.slice(words, c["start"] + 1, c["len"])
        return F.filter("candidates", lambda c: (F.xxhash64(part(c)) == c["phrase"]) & (F.xxhash64(F.lit("phrase"), part(c)) == c["check"]))

    # The outer array has one element, the document's words: they are then split once, not once for each candidate.
    found = F.flatten(F.transform(F.array(words_of(F.col("text"))), exact))
    return both.select("doc_id", "th", F.explode(found).alias("m")).select("doc_id", "th", "m.phrase", "m.start", F.col("m.len").alias("length"))


def proximity_matches(index: Index, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """doc_id, th, phrase, pos: places of the first of a phrase's rarest terms that all stand within size + slop words."""
    reach = size + slop
    lists = index.postings.join(small(index.near, index.n_anchors, BROADCAST_TERMS), "term").select("doc_id", "th", "phrase", "n", "k", "pos")
    stretch = F.floor(F.col("pos") / reach)
    dealt = lists.withColumn("stretch", F.explode(F.array(stretch, stretch - 1)))
    near = dealt.groupBy("doc_id", "th", "phrase", "n", "stretch").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("met"), F.collect_set(F.struct("pos", "k")).alias("places"))
    whole = near.where("met = shiftleft(1, n) - 1")

    def begins(p: Column) -> Column:
        within = F.filter("places", lambda x: (x["pos"] >= p["pos"]) & (x["pos"] < p["pos"] + reach))
        return (F.floor(p["pos"] / reach) == F.col("stretch")) & (F.size(F.array_distinct(F.transform(within, lambda x: x["k"]))) == F.col("n"))

    found = whole.select("doc_id", "th", "phrase", F.explode(F.filter("places", begins)).alias("p"))
    return found.select("doc_id", "th", "phrase", F.col("p.pos").alias("pos"))


def _items_by_row(matches: DataFrame, windows: DataFrame, name: str) -> DataFrame:
    of_phrase = windows.select("phrase", "item_id").distinct()
    rows = matches.select("doc_id", "th", "phrase").distinct().join(of_phrase, "phrase")
    return rows.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, anchors: int = ANCHORS, slop: int = SLOP) -> DataFrame:
    """Per row of docs: its columns, and n_words, n_hit (words inside exact occurrences), items (sorted ids as strings) and
    contaminated; and near_items, the items with a proximity match."""
    index = Index.build(docs, benchmark, size, anchors)
    matches = staged(phrase_matches(docs, index), "bench-matches")
    # of a document's occurrences in order, each adds the words that none before it has covered
    w = Window.partitionBy("doc_id", "th").orderBy("start")
    covered = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    places = matches.groupBy("doc_id", "th", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    new = places.withColumn("new", F.col("end") - F.least("end", F.greatest("start", F.coalesce(covered, F.col("start")))))
    parts = [
        index.postings.where("term = ''").groupBy("doc_id", "th").agg(F.max("pos").alias("n_words")),
        new.groupBy("doc_id", "th").agg(F.sum("new").alias("n_hit")),
        _items_by_row(matches, index.windows, "items"),
        _items_by_row(proximity_matches(index, size, slop), index.apart, "near_items"),
    ]
    names = ["n_words", "n_hit", "items", "near_items"]
    found = parts[0].select("doc_id", "th", F.struct("n_words", *[F.lit(None).cast(parts[i].schema[n].dataType).alias(n) for i, n in enumerate(names) if i]).alias("x"))
    for i, name in list(enumerate(names))[1:]:
        own = [F.col(n) if n == name else F.lit(None).cast(parts[j].schema[n].dataType).alias(n) for j, n in enumerate(names)]
        found = found.unionByName(parts[i].select("doc_id", "th", F.struct(*own).alias("x")))
    one = found.groupBy(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).agg(*[F.first(f"x.{n}", ignorenulls=True).alias(f"__{n}") for n in names])
    rows = docs.drop(*names, "contaminated").withColumn("__key", F.xxhash64("text"))
    joined = rows.join(one.hint("shuffle_hash"), [rows["doc_id"].eqNullSafe(one["__doc"]), rows["__key"] == one["__th"]], "left")
    none = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "n_words": F.coalesce("__n_words", F.lit(0)).cast("long"),
            "n_hit": F.coalesce("__n_hit", F.lit(0)).cast("long"),
            "items": F.coalesce("__items", none),
            "near_items": F.coalesce("__near_items", none),
            "contaminated": F.col("__n_hit").isNotNull(),
        }
    ).drop("__doc", "__th", "__key", *[f"__{n}" for n in names])
