"""Personal data and what reveals it: information-theoretic sanitisation. DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers, found by pattern and checked. Secrets are
the values given to keys, tokens and passwords, and credentials of known forms. Both are the protected entities. A term
is a word of a document that holds an entity, outside of e-mail addresses and secrets. Over all documents, with document
frequencies f,

    PMI(e; t) = log(N f(e, t) / (f(e) f(t)))        IC(e) = log(N / f(e))

and PMI / IC says how much of an entity's information its term discloses: 1 if the term occurs with the entity alone.
Terms whose share reaches GENERALISE are spans wherever they occur, in all texts; `sanitise` generalises them, and
removes those that reach REMOVE. With 0.95, the entity is the likelier guess for who sees the term of an entity of one
document, in a corpus of up to a million documents.

No number of common documents is asked for. Co-occurrence is counted over whole documents:

1. Entities that occur in the same rows have the same figures for every term and are one class, so a text that lists
   many entities makes few classes.
2. f(t) is counted over every word of every document, combined before the shuffle.
3. PMI / IC >= g only if f(t) <= f(e)^g N^(1-g), as f(e, t) <= f(e). Terms beyond that for all entities of their document
   are left out before pairs are made, so frequent words make no pairs but with frequent entities.
4. Texts that hold a disclosing term are found by a bit table of the terms' hashes, FILTER_WORDS words of 64 bits
   whatever the corpus, and joined with the terms if they pass it; no group is gathered in one task.

Patterns take each text once to see whether they occur, and are written without backtracking; they match what the
plain ones do (given beside them). Offsets are running sums over a document's matches of one kind.

Defined results. Null and empty texts have no spans. Rows are told apart by doc_id and text, so rows that share a doc_id
have spans of their own text, and identical rows alike; every row counts in f and N. Entities of all rows disclose nothing. Spans come by start, then kind as listed, then end. Other
columns pass through `sanitise`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm._shared import small, staged

#: Kinds in their order; patterns (fixed values) as `plain: without backtracking`.
#: email: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#: ip:    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card:  [0-9]([\x20-]?[0-9])+ where only 12 digits or more matter
#: phone: \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A value given to a key, token or password (group 1), with a digit; or a credential of a known form (fixed patterns).
SECRET = (
    r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,20}+[_-]){0,3}+(?i:key|token|secret|password|passwd|passphrase|pwd|credentials?)[\x22']?[\x20\x09]{0,3}+[:=][\x20\x09]{0,3}+[\x22']?"
    r"(?=[A-Za-z_./+=~-]*+[0-9])([A-Za-z0-9_./+=~-]{8,}+)"
    r"|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++)(?![A-Za-z0-9])"
)
KINDS = (*PATTERNS, "secret", "term")
TERM = r"[A-Za-z\x{80}-\x{10FFFF}]+"
#: ASCII characters that are no letters.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalpha())
LEAST_TERM = 3
GENERALISE, REMOVE = 0.95, 0.99
BROADCAST_TEXTS = 500_000
FILTER_WORDS = 1 << 19


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + worth(i)) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.length(F.ltrim(p, F.lit("0"))) < 3, 3).when(F.ltrim(p, F.lit("0")) <= "255", 3).otherwise(0)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", F.forall(F.split(value, r"\."), part))
        .when(kind == "card", F.when((n >= 12) & (n <= 19), luhn(_digits(value))).otherwise(False))
        .when(kind == "phone", (n >= 9) & (n <= 15))
        .otherwise(F.lit(True))
    )


def _may_have(kind: str, text: Column) -> Column:
    first = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}
    return (first[kind] if kind in first else F.lit(True)) & text.rlike(_pattern(kind))


def _pattern(kind: str) -> str:
    return SECRET if kind == "secret" else PATTERNS[kind]


def _matches(kind: str, text: Column) -> Column:
    """Per match: the length of the gap before it, its own, and its value, which ends where the match does."""
    pattern = _pattern(kind)
    value = lambda m: F.coalesce(F.nullif(F.regexp_extract(m, SECRET, 1), F.lit("")), m) if kind == "secret" else m

    def cut(gaps: Column) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
            lambda m, i: F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                F.length(F.element_at(gaps, i + 1)).alias("gap"),
                F.length(m).alias("n"),
                value(m).alias("value"),
            ),
        )

    found = F.flatten(F.transform(F.array(F.split(text, pattern, -1)), cut))
    return F.when(_may_have(kind, text), found)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, kind, start, end, value: the checked base spans and the secrets; offsets count code points, the end is exclusive."""
    every = F.flatten(F.filter(F.array(*[_matches(k, F.col("text")) for k in KINDS[:-1]]), lambda x: x.isNotNull()))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # before the explode, so matches of a row share it
    rows = numbered.select("doc_id", F.xxhash64("text").alias("th"), "row", F.explode(every).alias("m")).select("doc_id", "th", "row", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("n")).over(so_far)
    return (
        rows.withColumn("end", end)
        .withColumn("start", F.col("end") - F.length("value"))
        .where(valid(F.col("kind"), F.col("value")))
        .select("doc_id", "th", "kind", "start", "end", "value")
        .dropDuplicates(["doc_id", "th", "kind", "start"])
    )


def entity(kind: Column, value: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).when(kind == "secret", value).otherwise(F.lower(value)))


def _words(text: Column) -> Column:
    """The distinct terms of a text, of LEAST_TERM letters or more."""
    every = F.array_distinct(F.split(F.translate(F.lower(text), BETWEEN, " " * len(BETWEEN)), " ", -1))
    return F.filter(every, lambda w: F.length(w) >= LEAST_TERM)


def _same_row(left: DataFrame) -> list[Column]:
    return [left["doc_id"].eqNullSafe(F.col("__doc")), left["th"] == F.col("__th")]


def _renamed(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"doc_id": "__doc", "th": "__th"})


def contexts(docs: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, th, class, f_e of the entities of each row; and doc_id, th, copies (rows), most (the largest f_e) and term of all its terms."""
    own = staged(spans.select("doc_id", "th", entity(F.col("kind"), F.col("value")).alias("entity")).distinct(), "entities")
    may = reduce(lambda x, y: x | y, [_may_have(k, F.col("text")) for k in KINDS[:-1]])
    outside = F.regexp_replace(F.regexp_replace("text", PATTERNS["email"], " "), SECRET, " ")  # the other kinds have no letters
    rows = docs.where(may).select("doc_id", F.xxhash64("text").alias("th"), _words(outside).alias("terms"))
    rows = staged(rows.groupBy("doc_id", "th").agg(F.first("terms").alias("terms"), F.count("*").alias("copies")), "entity-rows")
    counted = own.join(_renamed(rows.drop("terms")), _same_row(own)).select("doc_id", "th", "entity", "copies")
    number = lambda seed: F.sum(F.xxhash64(F.lit(seed), "doc_id", "th").cast("decimal(38,0)"))
    by = counted.groupBy("entity").agg(F.sum("copies").alias("f_e"), F.xxhash64(F.count("*"), number(1), number(2)).alias("class"))
    classes = staged(own.join(by, "entity").select("doc_id", "th", "class", "f_e").distinct(), "entity-classes")
    most = classes.groupBy("doc_id", "th").agg(F.max("f_e").alias("most"))
    held = rows.join(_renamed(most), _same_row(rows)).select("doc_id", "th", "copies", "most", F.explode("terms").alias("term"))
    return classes, held


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, f: in how many rows each term occurs, over all documents."""
    return docs.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("f"))


def disclosures(docs: DataFrame, classes: DataFrame, held: DataFrame, least: float = GENERALISE) -> DataFrame:
    """class, term, share: terms that disclose at least the share of an entity's information."""
    n = docs.count()
    frequent = F.col("f") > F.pow(F.col("most"), F.lit(least)) * F.pow(F.lit(float(n)), F.lit(1 - least)) * (1 + 1e-9)
    rare = staged(held.join(document_frequencies(docs), "term").where(~frequent).drop("most"), "rare-terms")
    pairs = rare.join(_renamed(classes.where(F.col("f_e") < n)), _same_row(rare))
    counted = pairs.groupBy("class", "term", "f_e", "f").agg(F.sum("copies").alias("f_et"))
    share = F.log(n * F.col("f_et") / (F.col("f_e") * F.col("f"))) / F.log(n / F.col("f_e"))
    return counted.select("class", "term", share.alias("share")).where(F.col("share") >= least)


def _slot(term: Column) -> tuple[Column, Column]:
    """A term's word and bit in the bit table."""
    h = F.xxhash64(term)
    return F.pmod(h, F.lit(FILTER_WORDS)), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")


def holders(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, th of the rows whose text has one of the terms."""
    word, bit = _slot(F.col("term"))
    one = F.expr("shiftleft(1L, bit)")
    bits = told.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or(one).alias("bits"))  # at most FILTER_WORDS rows
    tokens = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(_words(F.col("text"))).alias("term")).withColumns({"word": word, "bit": bit})
    passed = tokens.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(one) != 0)
    # an inner join: a semi join would be moved before the bit table's
    return passed.select("doc_id", "th", "term").join(told.select("term").distinct(), "term").select("doc_id", "th").distinct()


def term_spans(docs: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, th, start, end, share: every occurrence of a disclosing term, in all texts that hold one."""
    shares = staged(told.groupBy("term").agg(F.max("share").alias("share")), "term-shares")
    held = staged(holders(docs, shares), "term-texts")
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("row"))
    texts = keyed.join(small(_renamed(held), held.count(), BROADCAST_TEXTS), _same_row(keyed), "left_semi")
    pairs = F.arrays_zip(F.split("text", TERM, -1).alias("gap"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("word"))
    words = texts.select("doc_id", "th", "row", F.posexplode(pairs).alias("i", "w")).where(F.col("w.word").isNotNull())
    end = F.sum(F.length("w.gap") + F.length("w.word")).over(Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = words.select("doc_id", "th", F.lower("w.word").alias("term"), F.length("w.word").alias("n"), end.alias("end")).join(shares, "term")
    return placed.select("doc_id", "th", (F.col("end") - F.col("n")).alias("start"), "end", "share").distinct()


def all_spans(docs: DataFrame) -> DataFrame:
    """doc_id, th, and spans: start, place (the kind's in KINDS), end, kind and share (of terms) of each, in order."""
    base = staged(base_spans(docs), "base-spans")
    told = staged(disclosures(docs, *contexts(docs, base)), "disclosures")
    terms = term_spans(docs, told)
    place = F.when(F.lit(False), 0)
    for i, kind in enumerate(KINDS):
        place = place.when(F.col("kind") == kind, i)
    rows = base.select("doc_id", "th", "kind", "start", "end", F.lit(None).cast("double").alias("share")).unionByName(terms.withColumn("kind", F.lit("term")))
    whole = rows.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", place.alias("place"), "end", "kind", "share"))).alias("spans"))
    own = F.filter("spans", lambda s: s["kind"] != "term")
    apart = F.filter("spans", lambda s: (s["kind"] != "term") | ~F.exists(own, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return whole.withColumn("spans", F.when(F.size(own) < F.size("spans"), apart).otherwise(F.col("spans")))


def with_spans(docs: DataFrame) -> DataFrame:
    """docs and their spans, an empty array where there is none."""
    found = all_spans(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": "__doc", "th": "__th", "spans": "__spans"})
    rows = docs.withColumn("__key", F.xxhash64("text"))
    kind = found.schema["__spans"].dataType
    joined = rows.join(found.hint("shuffle_hash"), [rows["doc_id"].eqNullSafe(found["__doc"]), rows["__key"] == found["__th"]], "left")
    return joined.withColumn("spans", F.coalesce("__spans", F.array().cast(kind))).drop("__doc", "__th", "__spans", "__key")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with spans, and text with base spans named by their kind, and terms generalised to [TERM] or removed."""

    def step(acc: Column, s: Column) -> Column:
        shown = F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["share"] >= REMOVE, "").otherwise("[TERM]")
        cut = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), shown).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(cut)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    return with_spans(docs).withColumn("text", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")))
