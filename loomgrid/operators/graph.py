"""The typed graph of documents, visits, procedures, footnotes and schedule entries, and its ordered inference rules.

Entries are rows: entry_id, procedure, canonical, visit, mark_type, raw_mark, occurrences, total, markers (an array), is_span.
A rule is a function of entries; `infer` applies rules by priority.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.grid import DAY_RANGE, FREQUENCY, unit_cost
from loomgrid.functions.temporal import fraction, frequency_multiplier, is_phone_call
from loomgrid.operators.budget import cycle_total

PROBABILITY = 0.6


@dataclass(frozen=True)
class Rule:
    name: str
    priority: int
    apply: Callable[[DataFrame], DataFrame]


def infer(entries: DataFrame, rules: list[Rule]) -> DataFrame:
    for rule in sorted(rules, key=lambda r: r.priority):
        entries = entries.transform(rule.apply)
    return entries


def cycle_rule(cycles: int, treat_to_progression: bool) -> Rule:
    """Totals of what is not excluded grow as the expected cycles to the shown ones."""
    shown, total = cycle_total(cycles, treat_to_progression)

    def apply(entries: DataFrame) -> DataFrame:
        grown = F.when(F.col("mark_type") != "excluded", (F.col("occurrences") * (total / shown)).cast("int")).otherwise(F.col("total"))
        return entries.withColumn("total", grown if total > shown else F.col("total"))

    return Rule("cycles", 10, apply)


def span_rule() -> Rule:
    """Spans with a day range happen daily, every 7 or every 30 days of it."""

    def apply(entries: DataFrame) -> DataFrame:
        raw = F.col("raw_mark")
        days = F.regexp_extract(raw, DAY_RANGE, 2).try_cast("int") - F.regexp_extract(raw, DAY_RANGE, 1).try_cast("int") + 1
        frequency = F.lower(F.regexp_extract(raw, FREQUENCY, 1))
        every = F.when(frequency == "weekly", 7).when(frequency == "monthly", 30).otherwise(1)
        times = F.greatest(F.lit(1), F.floor(days / every)).cast("int")
        known = F.col("is_span") & days.isNotNull()
        return entries.withColumns({"occurrences": F.when(known, times).otherwise(F.col("occurrences")), "total": F.when(known, times).otherwise(F.col("total"))})

    return Rule("spans", 20, apply)


def _by_marker(footnotes: DataFrame, kind: str, value: Column, at_most: int) -> DataFrame:
    """marker, value of the footnotes of a kind that have one; checked to be a small dimension before it is broadcast."""
    rows = footnotes.where(F.col("kind") == kind).select("marker", value.alias("value")).where("value IS NOT NULL")
    return F.broadcast(rows) if rows.count() <= at_most else rows


def frequency_rule(footnotes: DataFrame, at_most: int = 10_000) -> Rule:
    """Each matching marker, in order, multiplies the occurrences, rounded down, 1 at least; the total follows."""
    values = _by_marker(footnotes, "FREQUENCY_MODIFIER", frequency_multiplier(F.col("text")), at_most)

    def apply(entries: DataFrame) -> DataFrame:
        hits = entries.select("entry_id", F.posexplode("markers").alias("pos", "marker")).join(values, "marker")
        steps = hits.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("steps"))
        joined = entries.join(steps, "entry_id", "left")
        times = F.aggregate("steps", F.col("occurrences").cast("int"), lambda n, m: F.greatest(F.lit(1), (n * m).cast("int")))
        has = F.col("steps").isNotNull()
        return joined.withColumns({"occurrences": F.when(has, times).otherwise(F.col("occurrences")), "total": F.when(has, times).otherwise(F.col("total"))}).drop("steps")

    return Rule("frequency", 30, apply)


def conditional_rule(probability: float = PROBABILITY) -> Rule:
    return Rule("conditional", 40, lambda e: e.withColumn("probability", F.when(F.col("mark_type") == "conditional", probability)))


def subset_rule(footnotes: DataFrame, at_most: int = 10_000) -> Rule:
    """The last matching marker's share of the population."""
    values = _by_marker(footnotes, "SUBSET", fraction(F.col("text")), at_most)

    def apply(entries: DataFrame) -> DataFrame:
        hits = entries.select("entry_id", F.posexplode("markers").alias("pos", "marker")).join(values, "marker")
        last = hits.groupBy("entry_id").agg(F.max_by("value", "pos").alias("subset_fraction"))
        return entries.join(last, "entry_id", "left")

    return Rule("subset", 50, apply)


def phone_rule(footnotes: DataFrame, at_most: int = 10_000) -> Rule:
    rows = footnotes.where(is_phone_call(F.col("text"))).select("marker")
    calls = F.broadcast(rows) if rows.count() <= at_most else rows

    def apply(entries: DataFrame) -> DataFrame:
        hits = entries.select("entry_id", F.explode("markers").alias("marker")).join(calls, "marker").select("entry_id").distinct().withColumn("is_phone_call", F.lit(True))
        return entries.join(hits, "entry_id", "left").withColumn("is_phone_call", F.coalesce("is_phone_call", F.lit(False)))

    return Rule("phone calls", 70, apply)


def cost_override(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows with canonical and cost_tier: the override's tier, and its unit cost over the current one where both differ."""
    joined = rows.join(overrides, rows["canonical"] == overrides["canonical"], "left").drop(overrides["canonical"])
    current, new = unit_cost(F.col("cost_tier")), unit_cost(F.col("override"))
    ratio = F.when(F.col("override").isNotNull() & (new != current), F.round(new / current, 2))
    return joined.withColumn("multiplier", ratio).withColumn("cost_tier", F.coalesce("override", "cost_tier")).drop("override")


def entity_id(*parts: Column) -> Column:
    """The first 16 hex digits of the sha256 of document, type, name and further keys."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(16))


def hops(edges: DataFrame, kinds: list[str]) -> DataFrame:
    """start and end of the paths that follow edges (src, dst, kind) of these kinds in order."""
    path = edges.where(F.col("kind") == kinds[0]).select(F.col("src").alias("start"), F.col("dst").alias("end"))
    for kind in kinds[1:]:
        step = edges.where(F.col("kind") == kind).select(F.col("src").alias("end"), F.col("dst").alias("next"))
        path = path.join(step, "end").select("start", F.col("next").alias("end"))
    return path


def fired(rows: DataFrame, rules: list[tuple[str, int, dict[str, Column]]]) -> tuple[DataFrame, DataFrame]:
    """rows after all rules (name, priority, new values) in order of priority, and rule, n_changed of those that changed a row.

    Each rule leaves a flag in the rows, so one pass over them gives both.
    """
    flags = []
    for name, _, values in sorted(rules, key=lambda r: r[1]):
        changed = F.lit(False)
        for column, value in values.items():
            changed = changed | ~value.eqNullSafe(F.col(column))
        flag = f"__fired_{len(flags)}"
        rows = rows.withColumns({**values, flag: changed})
        flags.append((flag, name))
    each = F.array(*[F.when(F.col(f), F.lit(n)) for f, n in flags])
    log = rows.select(F.explode(each).alias("rule")).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n_changed"))
    return rows.drop(*[f for f, _ in flags]), log


def typed_graph(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (doc_id, kind, key, name) and edges (doc_id, kind, src, dst) of schedules. cells: doc_id, row_ix, col_ix, raw_value, visit, procedure.

    Visits and procedures of a document are one node for a name in small letters; the first name by its letters is shown.
    Entries are the cells with a mark.
    """
    key = lambda c: F.lower(F.trim(c))
    marked = cells.where(F.trim("raw_value") != "").withColumn("entry", F.concat_ws(":", F.col("row_ix").cast("string"), F.col("col_ix").cast("string")))
    of = lambda kind, c: cells.where(F.trim(c) != "").groupBy("doc_id", key(c).alias("key")).agg(F.min(c).alias("name")).select("doc_id", F.lit(kind).alias("kind"), "key", "name")
    visits, procedures = of("Visit", "visit"), of("Procedure", "procedure")
    document = cells.select("doc_id").distinct().select("doc_id", F.lit("Document").alias("kind"), F.col("doc_id").cast("string").alias("key"), F.col("doc_id").cast("string").alias("name"))
    entries = marked.groupBy("doc_id", "entry").agg(F.min("raw_value").alias("name")).select("doc_id", F.lit("ScheduleEntry").alias("kind"), F.col("entry").alias("key"), "name")
    has = lambda nodes, kind: nodes.select("doc_id", F.lit(kind).alias("kind"), F.col("doc_id").cast("string").alias("src"), F.col("key").alias("dst"))
    to = lambda kind, c: marked.select("doc_id", F.lit(kind).alias("kind"), F.col("entry").alias("src"), key(c).alias("dst"))
    edges = has(visits, "HAS_VISIT").unionByName(has(procedures, "HAS_PROCEDURE")).unionByName(to("SCHEDULED_AT", "visit")).unionByName(to("OF_PROCEDURE", "procedure"))
    return document.unionByName(visits).unionByName(procedures).unionByName(entries), edges
