"""Ordered classifiers of tables, regions, words and hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgrid.functions.grid import any_of

#: Patterns and words of the classifiers.
SCHEDULE_TITLE = r"(?i)schedule\s+of\s+(activities|assessments|events|evaluations|procedures|study)|study\s+procedures?\s+matrix|assessment\s+schedule|table\s+[0-9]+\s*[.:]\s*schedule"
OTHER_TITLE = r"(?i)adverse\s+event|demograph|abbreviat|reference\s+range|pharmacokinetic\s+parameter|dose\s+modification|statistical\s+method|signature\s+page"
VISIT_HEADER = r"(?i)visit\s*[0-9]|day\s*[-0-9]|week\s*[0-9]|baseline|screening|cycle\s*[0-9]|c[0-9]+d[0-9]+|treatment|follow.?up|randomization|eot|eos"
REJECT_TITLES = [
    "synopsis", "amendment", "objective", "endpoint", "abbreviation", "definition", "reference", "figure", "dosing schedule", "grading scale", "stopping rule", "intercurrent event", "estimand",
    "statistical method", "statistical analysis", "sensitivity analys", "adverse events of special interest", "populations for analys", "sample size", "power of demonstrating", "conditions and sample",
    "document history", "blood sampling volume", "grading of", "long-term efficacy", "immunogenicity endpoint", "summary of major changes", "protocol amendment", "schema",
]
ACCEPT_TITLES = [
    "schedule of activities", "schedule of assessments", "schedule of evaluations", "schedule of procedures", "schedule of events", "supplemental soe", "supplemental schedule", "soa", "s.o.a.", "soe", "schedule",
    "activities", "time and events", "time & events", "study procedures schedule", "study procedures matrix", "study procedures table", "study procedures overview", "assessment schedule", "assessment matrix",
    "assessment overview", "assessment plan", "visit schedule", "encounter schedule", "protocol flowchart", "study flowchart", "clinical trial flowchart", "table of activities", "table of assessments",
    "table of procedures", "table of study procedures", "treatment schedule", "dosing schedule", "evaluation schedule",
]
PAGE_TITLE = (
    r"(?i)schedule\s+of\s+(?:activities|assessments|evaluations|procedures|events)|time\s+and\s+events?\s+(?:table|schedule)|study\s+procedures?\s+(?:schedule|table|matrix)"
    r"|assessment\s+(?:schedule|matrix|overview)|(?:visit|encounter)\s+schedule|table\s+of\s+(?:study\s+)?(?:activities|assessments|procedures)|(?:treatment|dosing|evaluation)\s+schedule"
    r"|(?:^|\s)soa(?:\s|$)|(?:^|\s)s\.o\.a\.(?:\s|$)"
)
TABLE_CHROME = r"^(page [0-9]+|confidential$|[0-9]{1,2}\.[0-9]|pf-|protocol [a-z]|final protocol)"
PAGE_CHROME = r"^(page [0-9]+|confidential|protocol [a-z0-9]|pf-[0-9]+|final protocol|table [0-9]+|continued|abbreviation|note:|source:|[0-9]+\.[0-9]+)"
BODY_SIGNALS = [
    " if a ", " and the ", " will be ", " in order to ", " has been ", " required at ", " that covid", " whether ", " according to ", " prior to ", " sufficient ", " originally ", " determine ", " eligible ",
    " including mis-c", " between visit", " after each ", " the participant ", " the investigator ", " the requirement ", " the site ", "refer to the", "provide an overview", "section of the protocol",
    "compliance with", "all other participant", "remaining visits", "no later than", "not already been",
]
FRAGMENTS = r"^(to protocol|participant\.|those listed)"
FILLERS = ["the", "and", "for", "with", "from"]
COMPOUNDS = [
    "cannot", "nonetheless", "furthermore", "nevertheless", "notwithstanding", "throughout", "meanwhile", "otherwise", "whatever", "whenever", "wherever", "however", "moreover", "therefore", "outstanding",
    "understand", "understanding", "undertaken", "underlying", "undergoing", "overarching", "overwhelming", "overdose", "somewhere", "everywhere",
]
JOINED = ["the", "and", "for", "with", "from", "this", "that", "will", "shall", "must", "each", "been", "have", "were", "are", "was", "not", "all", "may", "can", "any"]


def _has(text: Column, words: list[str]) -> Column:
    return any_of([F.contains(F.lower(text), F.lit(w)) for w in words])


def table_type(title: Column, in_section: Column, markers: Column, cells: Column, visits: Column, rows: Column, cols: Column) -> Column:
    """STRUCT<kind, confidence> of a table from its signals, the first that applies."""
    ratio = markers / F.greatest(cells, F.lit(1))
    kinds = [
        (F.coalesce(title.rlike(OTHER_TITLE), F.lit(False)), "OTHER", 0.8),
        (F.coalesce(title.rlike(SCHEDULE_TITLE), F.lit(False)), "SOA", 0.9),
        (in_section & (markers >= 3), "SOA", 0.85),
        (in_section & (rows >= 5) & (cols >= 4), "SOA", 0.7),
        ((ratio > 0.3) & (visits >= 2), "SOA", 0.75),
        ((ratio > 0.2) & (rows >= 8), "SOA", 0.6),
    ]
    kind, confidence = F.when(F.lit(False), ""), F.when(F.lit(False), 0.0)
    for cond, name, value in kinds:
        kind, confidence = kind.when(cond, name), confidence.when(cond, value)
    return F.struct(kind.otherwise("OTHER").alias("kind"), confidence.otherwise(0.5).alias("confidence"))


def is_schedule(title: Column, schedule_on_page: Column, marks: Column, lines: Column, single: Column, pages: Column) -> Column:
    """Whether a region is taken as a schedule: by title, then by content; only a small page without a mark is not."""
    return (
        F.when(_has(F.coalesce(title, F.lit("")), REJECT_TITLES), False).when(_has(F.coalesce(title, F.lit("")), ACCEPT_TITLES), True).when(schedule_on_page | (marks >= 5), True)
        .when((lines >= 10) & (single / F.greatest(lines, F.lit(1)) > 0.5), True).when((marks == 0) & (lines < 20) & (pages <= 1), False).otherwise(True)
    )


def marks_in(text: Column) -> Column:
    """How many words X and how many ticks a text has."""
    words = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w == "X")
    return F.size(words) + F.length(text) - F.length(F.translate(text, "\u2713\u2714", ""))


def passes_layers(in_range: Column, likely: Column, marks: Column, cells: Column, flagged: Column, headers: Column, visit_headers: Column) -> Column:
    """Whether a region stays after all five layers.

    A region within the schedule's pages needs no likely content. Then go tables of more than 5 cells without a mark, of more
    than 10 without a mark whose cells are nearly all flagged, and of three headers or more of which none is a visit.
    """
    unmarked = marks == 0
    return (in_range | likely) & ~(unmarked & (cells > 5)) & ~((flagged >= 0.98) & unmarked & (cells > 10)) & ~((headers >= 3) & (visit_headers == 0))


def table_noise(text: Column) -> Column:
    """Whether a table row's text is plainly no data: page furniture, a section number, or a paragraph."""
    return F.lower(F.trim(text)).rlike(TABLE_CHROME) | (F.length(text) > 200)


def page_noise(text: Column) -> Column:
    """Whether a line is page furniture, body text or a fragment of a sentence, rather than a row's name."""
    low = F.lower(F.trim(text))
    body = any_of([F.contains(low, F.lit(x)) for x in BODY_SIGNALS])
    ends = low.rlike(r"[.,]$") & (F.length(text) > 80)
    lower_start = text.rlike(r"^[a-z]") & (F.length(text) > 30)
    return low.rlike(PAGE_CHROME) | (F.length(text) > 120) | body | ends | low.rlike(FRAGMENTS) | lower_start


def grounding(value: Column, column: Column, page_text: Column) -> Column:
    """STRUCT<grounded, adjustment>: how many of a value's words the page's text has."""
    v = F.lower(F.trim(value))
    words = F.filter(F.regexp_extract_all(v, F.lit("[a-z0-9_]{3,}"), F.lit(0)), lambda w: ~w.isin(*FILLERS))
    ratio = F.size(F.filter(words, lambda w: F.contains(page_text, w))) / F.greatest(F.size(words), F.lit(1))
    free = (column == 0) | (v == "") | ((F.length(v) <= 2) & v.isin("x", "y", "n", "✓", "✔")) | (F.size(words) == 0)
    return F.struct((free | (ratio >= 0.3)).alias("grounded"), F.when(free | (ratio >= 0.6), 1.0).when(ratio >= 0.3, 0.85).otherwise(0.75).alias("adjustment"))


def line_density(cells: Column) -> Column:
    return F.when(cells > 200, "high").when(cells > 50, "medium").otherwise("low")


def run_on(word: Column) -> Column:
    """A long word with a capital within, all of its parts of three letters or more."""
    clean = F.regexp_replace(word, "[^A-Za-z0-9_]", "")
    parts = F.split(F.regexp_replace(clean, "([a-z])([A-Z])", "$1 $2"), " ")
    return ~word.rlike("[-/.]") & ~F.lower(clean).isin(*COMPOUNDS) & (F.length(clean) > 20) & (F.size(parts) > 1) & ~F.exists(parts, lambda p: F.length(p) < 3)


def joined_words(text: Column) -> Column:
    """Pairs of common words written as one, each as it stands in the text."""
    one = "|".join(JOINED)
    found = F.regexp_extract_all(text, F.lit(f"(?i)((?:{one})(?:{one}))"), F.lit(1))
    pairs = {a + b for a in JOINED for b in JOINED}
    return F.filter(found, lambda w: ~F.lower(w).isin(*sorted(pairs & set(COMPOUNDS))) if pairs & set(COMPOUNDS) else F.lit(True))


def epoch_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("screen"), "screening").when(low.contains("run") & low.contains("in"), "run_in").when(low.contains("treat"), "treatment").when(low.contains("follow"), "follow_up").when(low.contains("extension"), "extension").otherwise("treatment")


def arm_type(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.contains("placebo"), "placebo").when(low.contains("control"), "control").when(low.contains("comparator"), "comparator").otherwise("experimental")


#: Categories whose procedures are effort without a unit of their own (fixed values).
EFFORT = ["Administrative", "Safety", "PRO"]


def is_effort(category: Column) -> Column:
    return F.coalesce(category.isin(*EFFORT), F.lit(False))


def cost_tier(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.rlike("imaging|scan|mri|treatment|infusion|administration") & ~(low.contains("lab") & ~low.rlike("imaging|scan|mri")), "HIGH").when(low.contains("lab"), "MEDIUM").otherwise("LOW")


def review_hints(confidence: Column, code: Column, category: Column, tier: Column, notes: Column, total: Column) -> Column:
    """What to look at in a budget line, or OK."""
    hints = F.concat_ws(
        "; ",
        F.when(confidence < 0.75, "low confidence: verify the frequency").when(confidence < 0.90, "some visit marks are uncertain"),
        F.when(F.coalesce(code, F.lit("")) == "", "no code").when(category == "Unknown", "verify the mapping"),
        F.when(tier == "VERY_HIGH", "high cost: verify the frequency"),
        F.when(F.coalesce(notes, F.lit("")) != "", F.concat(F.lit("conditional: "), F.left(notes, F.lit(50)))),
        F.when(total > 20, F.concat(F.lit("high frequency: "), total.cast("string"))),
    )
    return F.when(hints == "", "OK").otherwise(hints)
