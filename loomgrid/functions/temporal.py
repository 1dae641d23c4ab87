"""Visit headers, footnote texts and frequencies as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and patterns of visit headers and footnotes.
UNSCHEDULED = ["early termination", "et", "end of study", "eos", "end of treatment", "eot", "unscheduled", "discontinuation", "withdrawal"]
UNIT = r"(days?|weeks?|months?)"
CYCLE_SHORT = r"(?i)\bC([0-9]+)\s*D([0-9]+)\b"
CYCLE_LONG = r"(?i)\bcycle\s+([0-9]+)\s+day\s+([0-9]+)\b"
FOLLOW_UP = rf"(?i)follow[-\s]?up.*?([0-9]+)\s*{UNIT}"
SCREENING = rf"(?i)\(-?\s*([0-9]+)\s+to\s+-?\s*([0-9]+)\s*{UNIT}?\)"
ASYMMETRIC = rf"(?i)\(-?\s*([0-9]+)\s*/\s*\+?\s*([0-9]+)\s*{UNIT}\)"
SYMMETRIC = rf"(?i)[±+/-]\s*([0-9]+)\s*{UNIT}"
FOOTNOTES = {
    "EXCEPTION": r"\bexcept\b|\bunless\b|\bnot\s+required\b|\bexcluding\b",
    "FREQUENCY_MODIFIER": r"\bcycles?\s+[0-9]+\s*[-–]\s*[0-9]+\s+only\b|\bfirst\s+[0-9]+\s+cycles?\s+only\b|\bthen\s+(only\s+)?(on\s+)?day\s+1\b|\b(every|q)\s*[0-9]+\s*(cycles?|visits?)\b"
    r"|\breduced\s+frequency\s+after\b|\bevery\s+other\s+(visit|cycle)\b|\bday\s+[0-9]+\s+and\s+day\s+[0-9]+\s+of\b|\bonly\s+during\s+(cycle|induction|maintenance)\b",
    "CONDITIONAL": r"\bonly\s+if\b|\bif\s+[a-z0-9_]+|\bwhen\b|\bbased\s+on\b|\bper\s+investigator\b|\bas\s+needed\b|\bprn\b|\bclinically\s+indicated\b|\bat\s+the\s+discretion\b",
    "REFERENCE": r"\bsee\s+section\b|\brefer\s+to\b|\bsee\s+table\b|\bsee\s+appendix\b",
}
EVERY = r"(?i)every\s+([0-9]+)\s+(week|day|month)s?"
TIMES = r"(?i)([0-9]+)\s+times?\s+(per|each|every)\s+[a-z0-9_]+"
TWICE = r"(?i)(twice|three\s+times?)\s+(weekly|daily|per\s+[a-z0-9_]+)"
FRACTIONS = {
    "half": 0.5, "one-third": 0.33, "one third": 0.33, "two-thirds": 0.67, "two thirds": 0.67,
    "one-quarter": 0.25, "one quarter": 0.25, "three-quarters": 0.75, "three quarters": 0.75,
}
PHONE = r"\bcall\s+(all\s+)?(participants?|patients?|subjects?)\b|\b(phone|telephone)\s+(visit|contact|call|interview)\b|\b(via|by)\s+(phone|telephone)\b|\bwill\s+call\b|\btelemedicine\s+visit|\bremote\s+(visit|contact|assessment)\b"
PHONE_WORDS = r"phone|call"


def unit_of(text: Column) -> Column:
    return F.when(F.lower(text).startswith("week"), "WEEKS").when(F.lower(text).startswith("month"), "MONTHS").otherwise("DAYS")


def in_days(n: Column, unit: Column) -> Column:
    return F.when(unit == "WEEKS", n * 7).when(unit == "MONTHS", n * 30).otherwise(n)


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def visit(header: Column, loose: bool = False) -> Column:
    """STRUCT<target_day, window_minus, window_plus, window_unit, is_unscheduled, cycle>.

    Ordered: an unscheduled name, cycle and day, follow-up, then windows with Day, Week (7 days) or Month (30 days).
    An unscheduled word within a longer header counts as a whole word; loose also finds it inside words.
    """
    h = F.trim(header)
    low = F.lower(h)
    exact = low.isin(*UNSCHEDULED)
    short, long, follow = (F.regexp_extract(h, p, 1) != "" for p in (CYCLE_SHORT, CYCLE_LONG, FOLLOW_UP))
    follow_unit = unit_of(F.regexp_extract(h, FOLLOW_UP, 2))
    screening, asymmetric, symmetric = (F.regexp_extract(h, p, 1) != "" for p in (SCREENING, ASYMMETRIC, SYMMETRIC))
    minus = F.when(asymmetric, _number(h, ASYMMETRIC, 1)).when(screening, _number(h, SCREENING, 1)).when(symmetric, _number(h, SYMMETRIC, 1)).otherwise(0)
    plus = F.when(asymmetric, _number(h, ASYMMETRIC, 2)).when(screening, 0).when(symmetric, _number(h, SYMMETRIC, 1)).otherwise(0)
    window = unit_of(F.when(asymmetric, F.regexp_extract(h, ASYMMETRIC, 3)).when(screening, F.regexp_extract(h, SCREENING, 3)).when(symmetric, F.regexp_extract(h, SYMMETRIC, 2)).otherwise(""))
    named = {unit: F.regexp_extract(h, rf"(?i)\b{unit}\s+([0-9]+)\b", 1) for unit in ("day", "week", "month")}
    timed = (named["day"] != "") | (named["week"] != "") | (named["month"] != "")
    within = low.rlike("|".join(UNSCHEDULED) if loose else r"\b(" + "|".join(UNSCHEDULED) + r")\b")
    cycled = ~exact & (short | long)
    followed = ~exact & ~cycled & follow
    windowed = ~exact & ~cycled & ~followed & (timed | (~within & low.rlike("screen")))
    day = (
        F.when(exact, F.lit(None).cast("int"))
        .when(short, _number(h, CYCLE_SHORT, 2))
        .when(long, _number(h, CYCLE_LONG, 2))
        .when(follow, in_days(_number(h, FOLLOW_UP, 1), follow_unit))
        .when(named["day"] != "", named["day"].try_cast("int"))
        .when(named["week"] != "", named["week"].try_cast("int") * 7)
        .when(named["month"] != "", named["month"].try_cast("int") * 30)
    )
    by_month = windowed & (named["day"] == "") & (named["week"] == "") & (named["month"] != "")
    return F.struct(
        day.alias("target_day"),
        F.when(windowed, minus).otherwise(0).alias("window_minus"),
        F.when(windowed, plus).otherwise(0).alias("window_plus"),
        F.when(followed, follow_unit).when(by_month, "MONTHS").when(windowed, window).otherwise("DAYS").alias("window_unit"),
        (exact | (~cycled & ~followed & ~timed & within)).alias("is_unscheduled"),
        F.when(exact, F.lit(None).cast("int")).when(short, _number(h, CYCLE_SHORT, 1)).when(long, _number(h, CYCLE_LONG, 1)).alias("cycle"),
    )


def footnote_type(text: Column) -> Column:
    """The first kind of FOOTNOTES whose pattern the text has, else CLARIFICATION."""
    out = F.when(F.lit(False), "")
    for name, pattern in FOOTNOTES.items():
        out = out.when(text.rlike(f"(?i){pattern}"), name)
    return out.otherwise("CLARIFICATION")


def frequency_multiplier(text: Column) -> Column:
    every, times, twice = (F.regexp_extract(text, p, 1) for p in (EVERY, TIMES, TWICE))
    return F.when(every != "", 1.0 / F.greatest(every.try_cast("int"), F.lit(1))).when(times != "", times.try_cast("double")).when(F.lower(twice) == "twice", 2.0).when(twice != "", 3.0)


def fraction(text: Column) -> Column:
    percent = F.regexp_extract(text, r"([0-9]+)\s*%", 1).try_cast("int")
    out = F.when(percent.between(1, 100), percent / 100.0)
    for word, value in FRACTIONS.items():
        out = out.when(F.contains(F.lower(text), F.lit(word)), value)
    return out


def is_phone_call(text: Column) -> Column:
    return F.lower(text).rlike(PHONE_WORDS) & F.lower(text).rlike(PHONE)
