"""Normalisation of names against a vocabulary: an ordered cascade of matches, overlays of corrections, reports.

A vocabulary has entry_ix, canonical_name, code, category, cost_tier and aliases (an array). Exact names are joined by
equality first; only names that are still open go to the costlier steps. Prefixes are found by equality as well: a name
offers each of its prefixes that has the length of some alias.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.grid import SUPERSCRIPTS, similarity, token_overlap

LEAST_PREFIX, LEAST_WORD = 5, 3
BROADCAST_ALIASES = 50_000
#: Terms that name a procedure wherever they stand as whole words, and the alias that they stand for, in order (fixed values).
KEY_TERMS = [
    ("ecg", "ecg"), ("electrocardiogram", "ecg"), ("mri", "mri"), ("ct scan", "ct scan"), ("ct ", "ct scan"), ("pet", "pet/ct"), ("biopsy", "tumor biopsy"), ("x-ray", "x-ray"), ("xray", "x-ray"), ("spirometry", "spirometry"),
    ("echocardiogram", "echocardiogram"),
]


def aliases_of(vocabulary: DataFrame) -> DataFrame:
    """alias, entry_ix, alias_ix: lower-case names and aliases; of equal ones the first entry's."""
    names = F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))
    every = vocabulary.select("entry_ix", F.posexplode(names).alias("alias_ix", "alias")).select(F.lower(F.trim("alias")).alias("alias"), "entry_ix", "alias_ix").where("alias <> ''")
    first = every.groupBy("alias").agg(F.min(F.struct("entry_ix", "alias_ix")).alias("m"))
    return first.select("alias", "m.entry_ix", "m.alias_ix")


def cleaned_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """raw_name and cleaned: without raised marks, and without a last digit if only then it is an alias."""
    plain = F.trim(F.regexp_replace(F.trim("raw_name"), f"[{SUPERSCRIPTS}]+$", ""))
    bare = F.regexp_replace(F.col("plain"), "([a-zA-Z])[0-9]$", "$1")
    rows = names.select("raw_name").distinct().withColumn("plain", F.when(plain == "", F.trim("raw_name")).otherwise(plain)).withColumn("bare", bare)
    known = aliases.select(F.col("alias").alias("known"))
    joined = rows.join(known, F.lower("bare") == F.col("known"), "left")
    return joined.select("raw_name", F.when((F.col("bare") != F.col("plain")) & F.col("known").isNotNull(), F.col("bare")).otherwise(F.col("plain")).alias("cleaned"))


def exact_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    return names.join(aliases, F.lower("cleaned") == F.col("alias")).select("raw_name", "cleaned", "entry_ix", F.lit("exact").alias("method"), F.lit(1.0).alias("score"))


def prefix_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The longest alias that the name starts with."""
    usable = aliases.where(F.length("alias") >= LEAST_PREFIX)
    low = F.lower("cleaned")
    offered = names.select("raw_name", "cleaned", F.explode(F.sequence(F.lit(LEAST_PREFIX), F.greatest(F.lit(LEAST_PREFIX), F.length("cleaned")))).alias("n")).withColumn("start", F.left(low, F.col("n")))
    found = offered.where(F.length("start") == F.col("n")).join(usable, F.col("start") == F.col("alias"))
    best = found.groupBy("raw_name", "cleaned").agg(F.max_by("entry_ix", F.struct("n", -F.col("entry_ix"))).alias("entry_ix"))
    return best.select("raw_name", "cleaned", "entry_ix", F.lit("starts_with").alias("method"), F.lit(0.85).alias("score"))


def word_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The first alias (in the vocabulary's order) that stands in the name as whole words: found by its first word, then confirmed."""
    pieces = lambda c: F.filter(F.split(c, "[^a-z0-9]+"), lambda w: w != "")
    usable = aliases.where(F.length("alias") >= LEAST_WORD).withColumn("first", F.element_at(pieces(F.col("alias")), 1)).where("first IS NOT NULL")
    words = names.withColumn("low", F.lower("cleaned")).withColumn("word", F.explode(F.array_distinct(pieces(F.col("low")))))
    padded = F.concat(F.lit(" "), F.regexp_replace("low", "[^a-z0-9]+", " "), F.lit(" "))
    alias = F.concat(F.lit(" "), F.regexp_replace("alias", "[^a-z0-9]+", " "), F.lit(" "))
    found = words.join(usable, F.col("word") == F.col("first")).where(F.contains(padded, alias))
    best = found.groupBy("raw_name", "cleaned").agg(F.min_by("entry_ix", F.struct("entry_ix", "alias_ix")).alias("entry_ix"))
    return best.select("raw_name", "cleaned", "entry_ix", F.lit("word_match").alias("method"), F.lit(0.8).alias("score"))


def key_term_matches(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The first of KEY_TERMS that stands in the name as whole words and whose alias the vocabulary has."""
    low = F.lower("cleaned")
    terms = F.array(*[F.when(low.rlike(rf"\b{t}\b"), F.struct(F.lit(i).alias("i"), F.lit(a).alias("alias"))) for i, (t, a) in enumerate(KEY_TERMS)])
    offered = names.select("raw_name", "cleaned", F.explode(F.filter(terms, lambda t: t.isNotNull())).alias("t")).select("raw_name", "cleaned", "t.*")
    best = offered.join(aliases, "alias").groupBy("raw_name", "cleaned").agg(F.min_by("entry_ix", "i").alias("entry_ix"))
    return best.select("raw_name", "cleaned", "entry_ix", F.lit("key_term").alias("method"), F.lit(0.7).alias("score"))


def normalise(names: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """raw_name, cleaned, canonical_name, code, category, cost_tier, method: exact, then longest prefix, whole words, key terms; else unmatched."""
    aliases = aliases_of(vocabulary)
    open_ = cleaned_names(names, aliases)
    found = None
    for step in (exact_matches, prefix_matches, word_matches, key_term_matches):
        hit = step(open_, aliases)
        found = hit if found is None else found.unionByName(hit)
        open_ = open_.join(hit.select("raw_name"), "raw_name", "left_anti")
    found = found.unionByName(open_.select("raw_name", "cleaned", F.lit(None).cast(vocabulary.schema["entry_ix"].dataType).alias("entry_ix"), F.lit("unmatched").alias("method"), F.lit(0.0).alias("score")))
    joined = found.join(vocabulary.drop("aliases"), "entry_ix", "left")
    return joined.select(
        "raw_name", "cleaned", F.coalesce("canonical_name", "cleaned").alias("canonical_name"), "code", F.coalesce("category", F.lit("Unknown")).alias("category"),
        F.coalesce("cost_tier", F.lit("LOW")).alias("cost_tier"), "method", "score",
    )


def similar(names: DataFrame, aliases: DataFrame, least: float = 0.7) -> DataFrame:
    """The most similar alias of each name that shares a word with it: the larger of edit similarity and token overlap."""
    words = lambda c: F.explode(F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) > 1)))
    pairs = names.select("raw_name", words("raw_name").alias("w")).join(aliases.select("alias", "entry_ix", words("alias").alias("w")), "w").select("raw_name", "alias", "entry_ix").distinct()
    score = F.greatest(similarity(F.lower("raw_name"), F.col("alias")), token_overlap(F.col("raw_name"), F.col("alias")))
    scored = pairs.withColumn("score", score).where(F.col("score") >= least)
    return scored.groupBy("raw_name").agg(F.max("score").alias("score"), F.min_by("alias", F.struct(-F.col("score"), "alias")).alias("alias"))


def overlay(vocabulary: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections (canonical_name, action, code, aliases, pos) over a vocabulary: the last code wins, aliases are added, unknown names are new entries."""
    key = F.lower("canonical_name")
    latest = corrections.groupBy(key.alias("key")).agg(
        F.max_by(F.when(F.col("action") == "update_code", F.col("code")), F.when(F.col("action") == "update_code", F.col("pos"))).alias("new_code"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("action").isin("add", "update_aliases"), F.col("aliases")))))).alias("more"),
        F.max_by(F.when(F.col("action") == "add", F.col("canonical_name")), F.when(F.col("action") == "add", F.col("pos"))).alias("added"),
    )
    joined = vocabulary.withColumn("key", key).join(latest, "key", "full")
    kept = joined.where("canonical_name IS NOT NULL OR added IS NOT NULL")
    return kept.select(
        F.coalesce("canonical_name", "added").alias("canonical_name"),
        F.coalesce("new_code", "code").alias("code"),
        F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.coalesce("more", F.array().cast("array<string>")))).alias("aliases"),
        F.col("canonical_name").isNull().alias("is_new"),
    )


def statistics(vocabulary: DataFrame) -> DataFrame:
    """Entries and aliases over all, by category and by cost tier, in one grouping-sets pass."""
    rows = vocabulary.withColumn("n_aliases", F.size("aliases"))
    return rows.groupingSets([[], [F.col("category")], [F.col("cost_tier")]], "category", "cost_tier").agg(F.count("*").alias("n_entries"), F.sum("n_aliases").alias("n_aliases"), F.count("code").alias("n_codes"))


def search(vocabulary: DataFrame, text: str, limit: int) -> DataFrame:
    """Entries whose name or an alias contains the text, or whose code it is."""
    low = F.lit(text.lower())
    hit = F.contains(F.lower("canonical_name"), low) | F.exists("aliases", lambda a: F.contains(F.lower(a), low)) | (F.col("code") == text)
    return vocabulary.where(hit).orderBy("canonical_name", "entry_ix").limit(limit)


def match_report(normalised: DataFrame, by: Column) -> DataFrame:
    unmatched = F.col("method") == "unmatched"
    return normalised.groupBy(by.alias("group")).agg(F.count("*").alias("n"), F.count_if(unmatched).alias("n_unmatched"), F.avg((~unmatched).cast("int")).alias("match_rate"))


def row_procedures(rows: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, row_ix, procedure, exact: of the same name, else the first (by ix) of LEAST_PREFIX letters or more that the row's header begins with.

    rows: doc_id, row_ix, header; known: doc_id, name (small letters), ix. Rows without either are left out. A header offers
    each of its beginnings that has a length of some name in its document, so both are equi joins.
    """
    headed = rows.withColumn("low", F.lower(F.trim("header")))
    lengths = known.groupBy("doc_id").agg(F.collect_set(F.length("name")).alias("lengths"))
    offered = headed.join(lengths, "doc_id").select("doc_id", "row_ix", "low", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("low"))
    met = offered.withColumn("name", F.left("low", F.col("n"))).join(known, ["doc_id", "name"])
    exact = F.col("name") == F.col("low")
    usable = met.where(exact | (F.col("n") >= LEAST_PREFIX))
    best = usable.groupBy("doc_id", "row_ix").agg(F.min(F.struct((~exact).alias("x"), "ix", "name")).alias("m"))
    return best.select("doc_id", "row_ix", F.col("m.name").alias("procedure"), (~F.col("m.x")).alias("exact"))
