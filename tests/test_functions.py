import pytest
from pyspark.sql import functions as F

from loomgrid.functions import grid, temporal, text


def values(spark, expression, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["v"] for r in rows.select("i", expression(F.col("x")).alias("v")).orderBy("i").collect()]


def test_vote_values(spark):
    assert values(spark, grid.vote_value, ["Xa", "X⁴", "X^{a}", "CBC", "X4", "BNT162b2", " Yes ", None]) == ["x", "x", "x", "cbc", "x", "bnt162b2", "yes", None]


def test_marks(spark):
    found = values(spark, grid.mark, ["X", "Xa,b", "as needed", "--Weekly (Day 1 through Day 28)--", "", "Vital signs", "←→"])
    assert [(r["mark_type"], r["occurrences"]) for r in found] == [("firm", 1), ("firm", 1), ("conditional", 1), ("span", 4), ("empty", None), ("empty", None), ("span", None)]


def test_noise(spark):
    assert values(spark, grid.is_noise, ["Section 4.1", "SAE", "Vital signs", "", "60%", "x" * 151]) == [True, True, False, False, True, True]


@pytest.mark.parametrize(
    "header, day, minus, plus, unit, unscheduled, cycle",
    [
        ("Screening (-28 to -1 days)", None, 28, 0, "DAYS", False, None),
        ("Day 15", 15, 0, 0, "DAYS", False, None),
        ("Week 4 ±3 days", 28, 3, 3, "DAYS", False, None),
        ("Month 6", 180, 0, 0, "MONTHS", False, None),
        ("Week 2 (-2/+5 days)", 14, 2, 5, "DAYS", False, None),
        ("C2D15", 15, 0, 0, "DAYS", False, 2),
        ("Cycle 3 Day 8", 8, 0, 0, "DAYS", False, 3),
        ("Follow-up (30 days post-dose)", 30, 0, 0, "DAYS", False, None),
        ("ET", None, 0, 0, "DAYS", True, None),
        ("Early Termination Visit", None, 0, 0, "DAYS", True, None),
        ("Planet tour", None, 0, 0, "DAYS", False, None),
    ],
)
def test_visit_headers(spark, header, day, minus, plus, unit, unscheduled, cycle):
    r = values(spark, temporal.visit, [header])[0]
    assert tuple(r) == (day, minus, plus, unit, unscheduled, cycle)


def test_footnotes(spark):
    texts = ["Except at Visit 3", "Cycles 1-2 only, then Day 1", "Only if QTc > 450", "See Section 8", "Before dosing"]
    assert values(spark, temporal.footnote_type, texts) == ["EXCEPTION", "FREQUENCY_MODIFIER", "CONDITIONAL", "REFERENCE", "CLARIFICATION"]
    assert values(spark, temporal.frequency_multiplier, ["every 2 weeks", "3 times per cycle", "twice weekly", "once"]) == [0.5, 3.0, 2.0, None]
    assert values(spark, temporal.fraction, ["30% of patients", "half of them", "500%", "none"]) == [0.3, 0.5, None, None]
    assert values(spark, temporal.is_phone_call, ["Site will call participants", "Call the site", "by phone"]) == [True, False, True]


def test_lines_and_sections(spark):
    assert values(spark, text.line_style, ["1. Title", "1.2 Sub", "- item", "3) step", "body"]) == ["heading1", "heading2", "list_bullet", "list_number", "body"]
    assert values(spark, text.next_sibling, ["2.2.1", "3"]) == ["2.2.2", "4"]
    assert values(spark, text.strip_html, ["<p>a<b>b</b></p><script>x</script> &amp; c"]) == ["a b & c"]
    assert values(spark, text.salvage_json, ['{"a": 1}', "x {\"a\": 1} y", "none"]) == ['{"a": 1}', '{"a": 1}', None]


def test_compound_rows(spark):
    found = values(spark, grid.compound_terms, ["ICF, demographics, vital signs", "Recording of MAAEs, AE leading to withdrawal", "ECG", "a, b"])
    assert found == [["ICF", "demographics", "vital signs"], ["Recording of MAAEs, AE leading to withdrawal"], ["ECG"], ["a, b"]]
