"""Expressions on cell values: vote normalisation, marks, data types, cleaning, spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Superscript digits, marker characters, words and patterns of cell classification.
SUPERSCRIPTS = "²³⁴⁵⁶⁷⁸⁹¹⁰"
MARKERS = ["X", "✓", "✔", "√", "Y", "YES", "●", "•"]
EMBEDDED_MARK = r"^[XxYy✓✔√][A-Ga-g,0-9\s^]*$"
SPAN_EDGE = r"^[-<>─═]{3,}|[-<>─═]{3,}$"
SPAN_WITHIN = r"(?i)-{2,}.*(day|week|month).*-{2,}"
ARROWS = ["←→", "↔", "──"]
FREQUENCY = r"(?i)\b(daily|weekly|monthly|continuous)\b"
DAY_RANGE = r"(?i)day\s+([0-9]+)\s+(?:through|to|thru|[-–—])\s+day\s+([0-9]+)"
CONDITIONAL_CELL = r"(?i)as clinically indicated|if (clinically )?(appropriate|indicated|needed)|as needed|per investigator|at discretion|\bprn\b|may be performed"
TEXT_INDICATORS = ["required", "perform", "assess", "collect", "administer"]
NULL_WORDS = ["none", "null", "n/a", "nan"]
COST_TIERS = {"LOW": 75, "MEDIUM": 350, "HIGH": 1200, "VERY_HIGH": 3500, "PHONE_CALL": 35, "EDIARY": 10, "INFUSION": 2500, "BIOPSY": 4000}
ABBREVIATIONS = ["cci", "psrt", "sae", "sap", "srr", "soe", "teae", "uloq", "usp", "ve", "who", "s", "s-2p", "mild", "moderate", "severe", "none", "header", "fold rise", "ia1 35%", "ia2 70%"]
NOISE_STARTS = [
    "amendment [0-9]+", "original protocol", "section [0-9]+", "sections [0-9]+[.][0-9]+", "appendix [0-9]+", "synopsis", "table [0-9]+", "title page", "header$", "abbreviation", "estimand", "objective",
    "primary endpoint", "secondary endpoint", "exploratory objective", "long-term endpoint", "to evaluate", "to assess", "to demonstrate", "to conduct", "to infer", "cases of",
    "regardless of evidence", "part [a-z][0-9]?:", "all participants", "blinded participants", "unblinded participants", "placebo participants", "mrna-[0-9]+ participants",
    "participants who", "supplemental schedule", "modified supplemental", "section # and name", "continue with original", "counselling the importance", "true ve", "target ve",
    "header placeholder", "[0-9]+%$", "vaccine efficacy",
]
NOT_PROCEDURES = [
    "visit", "month", "week", "day", "year", "notes", "comments", "remarks", "assessment", "assessments", "monitoring", "laboratory tests", "timepoint",
    "arm", "cohort", "group", "period", "epoch", "cycle", "withdrawal",
]
LONGEST_NAME = 150
LAST_ROW, LAST_COLUMN = 500, 200


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def vote_value(raw: Column) -> Column:
    """The value that passes are compared by: without raised marks, trailing footnote letters and case."""
    v = F.regexp_replace(F.regexp_replace(F.trim(raw), r"\^\{[^}]+\}", ""), r"_\{[^}]+\}", "")
    v = F.regexp_replace(v, f"[{SUPERSCRIPTS}]+$", "")
    v = F.regexp_replace(v, "([A-Z✓✔✕✖])[a-f]$", "$1")
    v = F.when(F.length(v) <= 3, F.regexp_replace(v, "([a-zA-Z✓✔])[0-9]$", "$1")).otherwise(v)
    return F.lower(v)


def is_marker(raw: Column) -> Column:
    v = F.upper(F.regexp_replace(F.trim(raw), f"[{SUPERSCRIPTS}]+$", ""))
    return v.isin(*MARKERS) | F.trim(raw).rlike(EMBEDDED_MARK)


def data_type(raw: Column) -> Column:
    v = F.trim(raw)
    return F.when(v == "", "EMPTY").when(is_marker(v), "MARKER").when(v.rlike(r"^[0-9]+(\.[0-9]+)?$"), "NUMERIC").otherwise("TEXT")


def span_occurrences(raw: Column) -> Column:
    """How often a span such as `Weekly (Day 1 through Day 28)` happens; null without a day range and a frequency."""
    first, last = (F.regexp_extract(raw, DAY_RANGE, i) for i in (1, 2))
    days = last.try_cast("int") - first.try_cast("int") + 1
    frequency = F.lower(F.regexp_extract(raw, FREQUENCY, 1))
    of_range = F.when(frequency == "weekly", F.greatest(F.lit(1), F.floor(days / 7))).when(frequency == "monthly", F.greatest(F.lit(1), F.floor(days / 30))).otherwise(days)
    return F.when(first != "", of_range).when(frequency != "", F.lit(1)).cast("int")


def mark(raw: Column) -> Column:
    """STRUCT<mark_type, occurrences>: span, conditional, firm or empty, the first that applies."""
    v = F.trim(raw)
    is_span = v.rlike(SPAN_EDGE) | v.rlike(SPAN_WITHIN) | any_of([F.contains(v, F.lit(a)) for a in ARROWS])
    firm = is_marker(v) | any_of([F.contains(F.lower(v), F.lit(w)) for w in TEXT_INDICATORS])
    kind = F.when(v == "", "empty").when(is_span, "span").when(v.rlike(CONDITIONAL_CELL), "conditional").when(firm, "firm").otherwise("empty")
    times = F.when(kind == "span", span_occurrences(v)).when(kind.isin("conditional", "firm"), F.lit(1))
    return F.struct(kind.alias("mark_type"), times.alias("occurrences"))


def is_noise(value: Column) -> Column:
    """Whether a first-column text is a heading, endpoint, abbreviation or body text instead of a procedure."""
    v = F.trim(value)
    named = v.rlike("(?i)^(" + "|".join(NOISE_STARTS) + ")") | F.lower(v).isin(*ABBREVIATIONS)
    return (v != "") & (named | (F.length(v) > LONGEST_NAME) | (v.startswith("Section ") & F.contains(v, F.lit("/"))))


def clean_cells(cells):
    """Cells without impossible places; null words are EMPTY at 0.3 or less, first-column noise EMPTY at 0.1."""
    null_word = F.lower(F.trim("raw_value")).isin(*NULL_WORDS)
    noise = (F.col("col_ix") == 0) & (F.col("data_type") == "TEXT") & is_noise(F.col("raw_value"))
    return cells.where((F.col("row_ix") <= LAST_ROW) & (F.col("col_ix") <= LAST_COLUMN)).withColumns(
        {
            "confidence": F.when(null_word, F.least("confidence", F.lit(0.3))).when(noise, 0.1).otherwise(F.col("confidence")),
            "data_type": F.when(null_word | noise, "EMPTY").otherwise(F.col("data_type")),
            "raw_value": F.when(null_word | noise, "").otherwise(F.col("raw_value")),
        }
    )


def is_not_procedure(name: Column, patterns: list[str]) -> Column:
    key = F.lower(F.trim(name))
    return (F.length(key) < 3) | key.isin(*NOT_PROCEDURES) | any_of([F.contains(key, F.lit(p)) for p in patterns])


def compound_terms(name: Column) -> Column:
    """The parts of a row name such as `ICF, demographics, vital signs`, or the name alone if it is one procedure."""
    parts = F.filter(F.transform(F.split(name, ","), lambda t: F.trim(t)), lambda t: F.length(t) >= 3)
    joins = F.exists(F.slice(parts, F.lit(2), F.size(parts)), lambda t: t.rlike("(?i)leading to|relevant to|and |or "))
    return F.when((F.size(parts) >= 2) & ~F.exists(parts, lambda t: F.length(t) > 60) & ~joins, parts).otherwise(F.array(name))


def unit_cost(tier: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for name, cost in COST_TIERS.items():
        out = out.when(tier == name, cost)
    return out.otherwise(COST_TIERS["LOW"])


def markup(value: Column) -> Column:
    """^{a} and _{2} as sup and sub tags; known formulas and exponents likewise."""
    v = F.regexp_replace(F.regexp_replace(value, r"\^\{([^}]+)\}", "<sup>$1</sup>"), r"_\{([^}]+)\}", "<sub>$1</sub>")
    for formula in ("CO2", "PO4", "SO4", "NH4"):
        v = F.regexp_replace(v, rf"{formula}\b", f"{formula[:-1]}<sub>{formula[-1]}</sub>")
    v = F.regexp_replace(F.regexp_replace(v, r"H2O\b", "H<sub>2</sub>O"), "(?i)HbA1c", "HbA<sub>1c</sub>")
    v = F.regexp_replace(v, r"(^|[^A-Z])([ON])2\b", "$1$2<sub>2</sub>")
    v = F.regexp_replace(v, r"([0-9]+)\s*x\s*10([0-9]+)", "$1 × 10<sup>$2</sup>")
    return F.regexp_replace(v, r"(mg/m|[0-9]mm|[0-9]cm)2\b", "$1<sup>2</sup>")


def outermost_markers(value: Column) -> Column:
    """STRUCT<value, marker>: a raised letter at the end of a name, taken off as its footnote marker."""
    raised, plain = "ᵃᵇᶜᵈᵉᶠᵍʰ", "abcdefgh"
    last = F.right(value, F.lit(1))
    has = value.rlike(f"[{raised}]$")
    return F.struct(F.regexp_replace(value, f"[{raised}]$", "").alias("value"), F.when(has, F.translate(last, raised, plain)).alias("marker"))


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the distinct words of two or more characters."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), "[^a-z0-9]+"), lambda w: F.length(w) > 1))
    union = F.size(F.array_union(words(a), words(b)))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / union)


#: Raised letters, and words that a raised letter has run into, with what they are (fixed values).
RAISED = {"ᵃ": "a", "ᵇ": "b", "ᶜ": "c", "ᵈ": "d", "ᵉ": "e", "ᶠ": "f", "ᵍ": "g", "ʰ": "h"}
RUN_INTO = {
    "assessmente": "assessment", "assessmenta": "assessment", "assessmentd": "assessment", "appropriateb": "appropriate", "appropriated": "appropriate", "informationd": "information", "administrationf": "administration",
    "datesf": "dates", "resultsf": "results", "typingc": "typing", "typinge": "typing", "isolationc": "isolation", "isolatione": "isolation", "swab(s)c": "swab(s)",
}


def without_markers(text: Column) -> Column:
    """STRUCT<value, markers>: a name without the raised letter at its end and without one that has run into its last word."""
    raised = F.when(text.rlike(f"[{''.join(RAISED)}]$"), F.translate(F.right(text, F.lit(1)), "".join(RAISED), "".join(RAISED.values())))
    bare = F.when(raised.isNotNull(), F.left(text, F.length(text) - 1)).otherwise(text)
    suffix, clean = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for end, word in RUN_INTO.items():
        hit = F.lower(bare).endswith(end)
        suffix, clean = suffix.when(hit, end), clean.when(hit, word)
    n = F.length(suffix) - F.length(clean)
    run = F.when(suffix.isNotNull(), F.lower(F.right(bare, n)))
    value = F.when(suffix.isNotNull(), F.concat(F.left(bare, F.length(bare) - F.length(suffix)), clean)).otherwise(bare)
    return F.struct(value.alias("value"), F.filter(F.array(raised, run), lambda x: x.isNotNull()).alias("markers"))
