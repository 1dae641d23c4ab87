"""Measures of results and runs, and tables that new rows replace by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Points that an issue takes off a hundred, by its severity (fixed values).
POINTS = {"critical": 10.0, "high": 5.0, "medium": 2.0, "low": 0.5}
CONVENTION, DOUBLES, FONTS = 0.3, 5, 2


def marker_coverage(truth: DataFrame, found: DataFrame) -> DataFrame:
    """By doc_id, how many markers the truth has and the share of them that was found."""
    a, b = truth.distinct(), found.distinct().withColumn("there", F.lit(1))
    return a.join(b, ["doc_id", "marker"], "left").groupBy("doc_id").agg(F.count("*").alias("n_markers"), (F.count("there") / F.count("*")).alias("coverage"))


def export_summary(attributes: DataFrame, by: str) -> DataFrame:
    """Tables, cells, mean sizes, and how many tables have merged cells, footnotes and conditional marks."""
    flags = {f"with_{c}": F.count_if(F.col(c)) for c in ("merged", "footnotes", "conditional")}
    return attributes.groupBy(by).agg(
        F.count("*").alias("num_tables"), F.sum(F.col("n_rows") * F.col("n_cols")).alias("total_cells"), F.avg("n_rows").alias("avg_rows"), F.avg("n_cols").alias("avg_cols"), *[v.alias(k) for k, v in flags.items()]
    )


def run_stability(runs: DataFrame, by: list[str], n_runs: int) -> DataFrame:
    """Cells of all runs; the percentage that is the same in each, a missing cell being empty; the mean share of the
    commonest value; and the sample deviation of the runs' cell counts. runs: by, row_ix, col_ix, raw_value, run (once each)."""
    place = [*by, "row_ix", "col_ix"]
    values = runs.groupBy(*place, F.trim("raw_value").alias("value")).agg(F.count("*").alias("n"))
    seen = values.groupBy(*place).agg(F.sum("n").alias("present"), F.max("n").alias("most"), F.max(F.when(F.col("value") == "", F.col("n")).otherwise(0)).alias("blank"))
    most = F.greatest("most", F.col("blank") + n_runs - F.col("present"))
    stable = seen.groupBy(*by).agg(F.count("*").alias("n_cells"), (100 * F.avg((most == n_runs).cast("int"))).alias("stable_pct"), F.avg(most / n_runs).alias("mean_stability"))
    counts = runs.groupBy(*by, "run").agg(F.count("*").alias("c")).groupBy(*by).agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    variance = (F.col("q") - F.col("s") * F.col("s") / n_runs) / max(1, n_runs - 1)
    return stable.join(counts.select(*by, F.sqrt(F.greatest(variance, F.lit(0.0))).alias("cell_count_stddev")), by)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows of both by key, the new one where both have it; replaced says where."""
    rest = [c for c in old.columns if c != key]
    renamed = new.select(key, F.struct(*rest).alias("__new"))
    joined = old.withColumn("__old", F.lit(True)).join(renamed, key, "full")
    values = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) for c in rest]
    return joined.select(key, *values, (F.col("__new").isNotNull() & F.col("__old").isNotNull()).alias("replaced"))


def renormalised(lines: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """lines (name, code) with the vocabulary's new_code, unless the name is unknown there or its category is."""
    known = vocabulary.where("category <> 'Unknown'").select("name", "new_code", F.lit(True).alias("__known"))
    joined = lines.join(known, "name", "left")
    return joined.withColumns({"code": F.when(F.col("__known"), F.col("new_code")).otherwise(F.col("code")), "renewed": F.coalesce("__known", F.lit(False))}).drop("__known", "new_code")


def duplicate_headers(headers: DataFrame) -> DataFrame:
    """doc_id, header, n: headers that more than one column of a document has."""
    return headers.groupBy("doc_id", "header").agg(F.count("*").alias("n")).where("n > 1")


def model_statistics(entities: DataFrame) -> DataFrame:
    """How many entities of each kind a document's model has. entities: doc_id, kind, mark."""
    kind, mark = F.col("kind"), F.col("mark")
    counts = {"visits": kind == "Visit", "procedures": kind == "Procedure", "schedule_entries": kind == "ScheduleEntry", "firm_entries": mark == "firm", "conditional_entries": mark == "conditional", "footnotes": kind == "Footnote"}
    return entities.groupBy("doc_id").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def paragraph_issues(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """by, severity, n: spacing and font issues of paragraphs (line, n_fonts).

    More than DOUBLES double spaces in a paragraph are low, unless more than the share CONVENTION of all paragraphs has some;
    each capital right after a full stop is high; more than FONTS fonts in a paragraph are medium.
    """
    doubles, unspaced = F.regexp_count("line", F.lit("  +")), F.regexp_count("line", F.lit("[.][A-Z]"))
    found = paragraphs.groupBy(*by).agg(
        (F.avg((doubles > 0).cast("int")) > CONVENTION).alias("convention"), F.count_if(doubles > DOUBLES).alias("doubled"), F.sum(unspaced).alias("high"), F.count_if(F.col("n_fonts") > FONTS).alias("medium")
    )
    low = F.when(F.col("convention"), 0).otherwise(F.col("doubled"))
    pairs = F.array(*[F.struct(F.lit(s).alias("severity"), n.cast("long").alias("n")) for s, n in (("low", low), ("medium", F.col("medium")), ("high", F.col("high")))])
    return found.select(*by, F.explode(pairs).alias("x")).select(*by, "x.*")


def fidelity(issues: DataFrame, by: list[str]) -> DataFrame:
    """A hundred less the points of all issues, at least 0, and the number of each severity. issues: by, severity, n."""
    n = {s: F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0)) for s in POINTS}
    off = sum((n[s] * p for s, p in POINTS.items()), F.lit(0.0))
    return issues.groupBy(*by).agg(*[v.alias(f"n_{s}") for s, v in n.items()], F.greatest(F.lit(0.0), 100 - off).alias("fidelity"))


def imported(current: DataFrame, rows: DataFrame) -> DataFrame:
    """A vocabulary (name, code, aliases) after an import: names meet without regard to case; an imported code counts, aliases are added."""
    a = current.withColumn("key", F.lower("name"))
    b = rows.select(F.lower("name").alias("key"), F.col("name").alias("new_name"), F.col("code").alias("new_code"), F.col("aliases").alias("more"))
    none = F.array().cast("array<string>")
    had, more = F.coalesce("aliases", none), F.coalesce("more", none)
    low = F.transform(had, F.lower)
    fresh = F.filter(more, lambda x: ~F.array_contains(low, F.lower(x)))
    joined = a.join(b, "key", "full")
    return joined.select(F.coalesce("name", "new_name").alias("name"), F.coalesce("new_code", "code").alias("code"), F.concat(had, fresh).alias("aliases"), F.col("name").isNull().alias("inserted"))


def named_like(files: DataFrame, file: str, documents: DataFrame) -> DataFrame:
    """files with doc_id and key of the documents whose name, letters and digits only, the file's begins with. Beginnings of the names' lengths are offered, so it is an equi join."""
    bare = lambda c: F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    known = documents.select("doc_id", bare(F.col("name")).alias("key")).where("key <> ''")
    lengths = known.agg(F.collect_set(F.length("key")).alias("lengths"))  # one row
    own = files.withColumn("__bare", bare(F.regexp_replace(file, "(?i)[.]pdf$", ""))).join(F.broadcast(lengths))
    offered = own.select(*files.columns, F.explode("lengths").alias("__n"), "__bare").where(F.col("__n") <= F.length("__bare"))
    return offered.withColumn("key", F.left("__bare", F.col("__n"))).join(known, "key").select(*files.columns, "doc_id", "key")
