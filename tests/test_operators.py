import json

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import budget, evaluate, formulas, graph, intervals, reconcile, vocabulary
from loomgrid.sources.render import to_graph_json, to_markdown_table
from loomgrid.streaming.logs import checkpointed, latest_state, read_log, windowed_counts

CELL = "doc_id long, row_ix int, col_ix int, raw_value string"


def keyed(df, *columns):
    return {(r["doc_id"], r["row_ix"], r["col_ix"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 1, 1, "X"), (1, 1, 2, "X"), (1, 1, 3, "Y"), (1, 1, 5, None)], CELL)
    b = spark.createDataFrame([(1, 1, 1, "Xa"), (1, 1, 2, "N"), (1, 1, 4, "X")], CELL)
    issues = spark.createDataFrame([(1, 1, 4, 0.4), (1, 1, 4, 0.2), (1, None, None, 0.9)], "doc_id long, row_ix int, col_ix int, severity double")
    tiers = spark.createDataFrame([(1, 1, 1, "VERY_HIGH"), (1, 1, 3, "LOW")], "doc_id long, row_ix int, col_ix int, cost_tier string")
    found = keyed(reconcile.reconcile(a, b, issues, tiers), "raw_value", "confidence", "conflict", "flagged")
    assert found[1, 1, 1] == ("Xa", 0.95, False, False)
    assert found[1, 1, 2] == ("X", 0.5, True, True)
    assert found[1, 1, 3] == ("Y", 0.7, False, True)
    assert found[1, 1, 4] == ("X", pytest.approx(0.56), False, True)


def test_consensus_takes_the_longest_of_two_equal_votes(spark):
    r = spark.createDataFrame([(1, 1, 1, "N", 0.5)], CELL + ", confidence double")
    passes = [spark.createDataFrame([(1, 1, 1, x)], CELL) for x in ("N", "X", "Xa")]
    assert keyed(reconcile.consensus(r, passes), "raw_value", "confidence", "resolved") == {(1, 1, 1): ("Xa", 0.9, True)}


def test_empty_passes(spark):
    empty = spark.createDataFrame([], CELL)
    issues = spark.createDataFrame([], "doc_id long, row_ix int, col_ix int, severity double")
    tiers = spark.createDataFrame([], "doc_id long, row_ix int, col_ix int, cost_tier string")
    assert reconcile.reconcile(empty, empty, issues, tiers).count() == 0


def test_normalisation_cascade(spark):
    vocab = spark.createDataFrame(
        [(1, "Electrocardiogram", "93000", "Cardiac", "MEDIUM", ["ECG", "12-lead ECG"]), (2, "Blood draw", None, "Lab", "LOW", ["phlebotomy"])],
        "entry_ix long, canonical_name string, code string, category string, cost_tier string, aliases array<string>",
    )
    names = spark.createDataFrame([("ecg",), ("Blood draw (fasting)",), ("pre-dose ECG reading",), ("Phlebotomy²",), ("blood draw5",), ("xyz",)], "raw_name string")
    found = {r["raw_name"]: (r["canonical_name"], r["method"]) for r in vocabulary.normalise(names, vocab).collect()}
    assert found == {
        "ecg": ("Electrocardiogram", "exact"), "Blood draw (fasting)": ("Blood draw", "starts_with"), "pre-dose ECG reading": ("Electrocardiogram", "word_match"),
        "Phlebotomy²": ("Blood draw", "exact"), "blood draw5": ("Blood draw", "exact"), "xyz": ("xyz", "unmatched"),
    }


def test_cycles():
    assert budget.cycle_total(1, True) == (1, 1)
    assert budget.cycle_total(3, True) == (3, 12)
    assert budget.cycle_total(9, False) == (9, 9)


def test_intervals(spark):
    pages = spark.createDataFrame([(1, p) for p in (1, 2, 5, 9)], "d int, page int")
    assert [r["session"] for r in intervals.sessions(pages, ["d"], "page", 1).orderBy("page").collect()] == [0, 0, 1, 2]
    assert [r["page"] for r in intervals.fill_gaps(pages, ["d"], "page").orderBy("page").collect()] == [1, 2, 3, 4, 5, 9]
    spans = spark.createDataFrame([(1, 0, 4), (1, 0, 9), (1, 5, 7), (1, 9, 12)], "d int, start long, end long")
    assert sorted((r["start"], r["end"]) for r in intervals.greedy_apart(spans, ["d"]).collect()) == [(0, 9), (9, 12)]


def test_rules_run_by_priority(spark):
    notes = spark.createDataFrame([("b", "every 2 weeks", "FREQUENCY_MODIFIER"), ("f", "30% of patients", "SUBSET")], "marker string, text string, kind string")
    rows = spark.createDataFrame([(1, "firm", "X", False, 4, 4, ["b", "f"]), (2, "excluded", "", False, 1, 1, [])], "entry_id long, mark_type string, raw_mark string, is_span boolean, occurrences int, total int, markers array<string>")
    found = graph.infer(rows, [graph.subset_rule(notes), graph.frequency_rule(notes), graph.cycle_rule(3, True)])
    by_id = {r["entry_id"]: r for r in found.collect()}
    assert (by_id[1]["occurrences"], by_id[1]["total"], by_id[1]["subset_fraction"]) == (2, 2, 0.3)
    assert by_id[2]["total"] == 1


def test_sequence_distance():
    assert evaluate.edit_distance(["a", "b"], ["a", "b"]) == 0
    assert evaluate.edit_distance(["a"], []) == 1
    assert evaluate.edit_distance(["a", "b", "c"], ["a", "c"]) == 1


def test_formulas_do_not_overlap():
    text = "dC/dt = -k C and x^2 with n! and p < 0.05"
    found = formulas.spans_of(text)
    assert [text[f["start"] : f["end"]] for f in found] == ["dC/dt", "x^2", "n!", "p < 0.05"]


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("n = (Zα + Zβ)² × 2σ² / δ²", ["sample_size"]), ("CrCl = (140 - age) × weight / 72", ["clearance"]), ("f2 = 50 log (100 / x)", ["similarity_factor"]), ("HR = 0.75 and 12 ± 3", ["ratio", "mean_deviation"]),
        ("5 x 10^6 at 20 mg/m²", ["scientific", "area_dose"]), ("P(5, 2) and exp(x)", ["permutation", "function"]), ("AUC0-inf, Cmax", ["pharmacokinetic", "pharmacokinetic"]), ("no formula here", []), ("", []),
    ],
)
def test_formula_kinds(text, kinds):
    assert [f["kind"] for f in formulas.spans_of(text)] == kinds


def test_formulas_are_marked(spark):
    rows = spark.createDataFrame([("a x^2 b",), (None,)], "t string")
    assert [r["h"] for r in formulas.annotate(rows, "t", "h").collect()] == ['a <span class="formula" data-kind="power">x^2</span> b', None]


def test_renderers(spark):
    cells = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, 2, 1, "c"), (1, 2, 2, "d")], CELL)
    assert to_markdown_table(cells, ["doc_id"]).first()["markdown"] == "| a | b |\n| c | d |"
    nodes = spark.createDataFrame([(1, "x", "k")], "doc_id long, id string, kind string")
    edges = spark.createDataFrame([], "doc_id long, src string, dst string, kind string")
    assert json.loads(to_graph_json(nodes, edges, "doc_id").first()["graph"]) == {"nodes": [{"id": "x", "kind": "k"}], "edges": []}


def test_log_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [{"event_id": i, "ts": f"2024-01-0{1 + i % 2}T00:00:00Z", "user_id": i % 3, "event_type": "view", "value": 1.0, "props": "{}"} for i in range(10)]
    (log / "a.json").write_text("\n".join(map(json.dumps, rows)))
    stream = windowed_counts(read_log(spark, str(log)), "1 day")
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert sum(r["n"] for r in spark.table("counts").collect()) == 10
    checkpointed(read_log(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination(60)
    assert latest_state(spark.read.parquet(str(tmp_path / "out"))).count() == 3


PAGE = """<html><head><title>t</title><style>p{}</style></head><body style="color:#111"><script>var a = "<p>no</p>";</script>
<h2>Head <i>line</i></h2><p style="text-align: center">One <b>two <u>three</u></b> &amp; four<br>five<p>open<ul><li>a<ol><li>b</li></ol></li><li>c</li></ul>
<blockquote>q<p>r</p></blockquote><hr><table><tr><th rowspan=2 colspan=2>h</th><td>x</td></tr><tr><td><a href="/l">y</a></td></tr></table>tail</body></html>"""


def test_html_blocks(spark):
    from loomgrid.operators import html

    rows = html.blocks(spark.createDataFrame([(1, PAGE), (2, None), (3, "</p></table></b>just text"), (4, "")], "id long, h string"), "id", "h").orderBy("id", "block").collect()
    found = [(r["kind"], r["text"], r["depth"]) for r in rows if r["id"] == 1]
    assert found == [
        ("heading2", "Head line", 0), ("body", "One two three & four five", 0), ("body", "open", 0), ("list_bullet", "a", 1), ("list_number", "b", 2), ("list_bullet", "c", 1), ("quote", "q", 1), ("quote", "r", 1), ("rule", "---", 0),
        ("header_cell", "h", 0), ("cell", "x", 0), ("cell", "y", 0), ("body", "tail", 0),
    ]
    cells = [(r["tab"], r["row_ix"], r["col_ix"], r["rows"], r["cols"]) for r in rows if r["kind"].endswith("cell")]
    assert cells == [(0, 0, 0, 2, 2), (0, 0, 2, 1, 1), (0, 1, 2, 1, 1)]
    para = rows[1]
    assert para["align"] == "center" and [(s["text"], s["formats"]) for s in para["spans"]][:3] == [("One ", []), ("two ", ["bold"]), ("three", ["bold", "underline"])]
    assert para["spans"][0]["style"].startswith("color:#111") and next(r for r in rows if r["text"] == "y")["spans"][0]["link"] == "/l"
    assert [(r["id"], r["kind"], r["text"]) for r in rows if r["id"] != 1] == [(3, "body", "just text")]


def test_cut_references_are_text_where_sql_has_them(spark, tmp_path):
    import duckdb

    from loomgrid.operators import html
    from loomgrid.plans import documents

    said = ["a &amp; b", "cut &amp", "cut &am", "cut &", "&ampB &ampB;", "&amp;copy; &amp;amp &copy; &copy", "&#38 &#x", "a\vb &middot;", "&nosuch; &quot;q&quo"]
    pages = spark.createDataFrame([(i, f"<h1>{t}</h1><article><p>{t}</p><li>{t}</article>") for i, t in enumerate(said)], "page_id long, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = duck.execute(documents.SQL["a6_html_blocks"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r[c] for c in names) for r in documents.a6_html_blocks(spark, str(tmp_path)).collect()) == sorted(want.fetchall())
    assert [b[2] for b in html.read("<p>x &amp<p>&#38")] == ["x &", "&"]
    assert [b[2] for b in html.read('<p>x &amp<p>&#38;<a href="?a&lt">&lt;&ltb</a>', strict=True)] == ["x &amp", "&<&ltb"]


def test_every_tag_of_random_pages_is_read(spark):
    import random

    from loomgrid.operators import html

    rng = random.Random(4)
    tags = ["p", "b", "i", "ul", "li", "ol", "table", "tr", "td", "div", "h3", "blockquote", "span"]
    for _ in range(300):
        pieces, words = [], []
        for k in range(30):
            tag = rng.choice(tags)
            pieces.append(rng.choice([f"<{tag}>", f"</{tag}>", f"w{k} "]))
            words += [pieces[-1].strip()] if pieces[-1].startswith("w") else []
        assert " ".join(b[2] for b in html.read("".join(pieces)) if b[1] != "rule").split() == words


def test_sections_are_clipped_and_found(spark):
    from loomgrid.operators import sections

    lines = spark.createDataFrame([(1, 0, 10.0, "before"), (1, 0, 40.0, "1. Start"), (1, 1, 5.0, "Page 2"), (1, 1, 20.0, " kept "), (1, 1, 30.0, ""), (1, 2, 10.0, "see Section 2"), (1, 2, 50.0, "2. Next")], "doc_id long, page int, y double, line string")
    ranges = spark.createDataFrame([(1, "1", 0, 41.0, 2, 50.0), (1, "2", 2, 50.0, 2, None)], "doc_id long, number string, page int, start_y double, end_page int, end_y double")
    found = sections.clipped_lines(lines, ranges)
    assert sorted((r["number"], r["line"]) for r in found.collect()) == [("1", "1. Start"), ("1", "kept"), ("1", "see Section 2"), ("2", "2. Next")]
    html = {r["number"]: r["html"] for r in sections.section_html(found).collect()}
    assert html["1"].startswith("<h1>1. Start</h1>\n<p>kept</p>\n<p>see <a href") and html["2"] == "<h1>2. Next</h1>"


def test_rules_that_change_nothing_have_not_fired(spark):
    rows = spark.createDataFrame([(1, 5), (2, None)], "id long, v int")
    after, log = graph.fired(rows, [("late", 2, {"v": F.col("v") + 1}), ("early", 1, {"v": F.coalesce("v", F.lit(0))}), ("none", 3, {"id": F.col("id")})])
    assert sorted(map(tuple, after.collect())) == [(1, 6), (2, 1)] and sorted(map(tuple, log.collect())) == [("early", 1), ("late", 2)]
