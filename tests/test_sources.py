import json

from pyspark.sql import functions as F

from loomgrid.functions import classify
from loomgrid.operators import vocabulary as names
from loomgrid.sources import jsons, stores, vocabulary

CSV = """# a comment
canonical_name,cpt_code,code_system,category,cost_tier,aliases
Electrocardiogram,93000,CPT,Cardiac,MEDIUM,"ECG, 12-lead ECG"
# another
Blood draw,,,Lab,SOMETHING,"phlebotomy,"
,1,,,LOW,x
"""


def test_vocabulary_files(spark, tmp_path):
    (tmp_path / "v.csv").write_text(CSV)
    rows = {r["canonical_name"]: r for r in vocabulary.read_vocabulary(spark, str(tmp_path / "v.csv")).collect()}
    assert set(rows) == {"Electrocardiogram", "Blood draw"}
    assert rows["Electrocardiogram"]["aliases"] == ["ecg", "12-lead ecg"] and rows["Blood draw"]["code"] is None and rows["Blood draw"]["cost_tier"] == "LOW"
    vocabulary.write_vocabulary(vocabulary.read_vocabulary(spark, str(tmp_path / "v.csv")), str(tmp_path / "out"))
    again = {r["canonical_name"]: r["aliases"] for r in vocabulary.read_vocabulary(spark, str(tmp_path / "out")).collect()}
    assert again == {n: r["aliases"] for n, r in rows.items()}


def test_corrections_overlay(spark, tmp_path):
    (tmp_path / "v.csv").write_text(CSV)
    (tmp_path / "c").mkdir()
    for k, code in ((1, "1"), (2, "2")):
        items = [{"action": "update_code", "canonical_name": "blood draw", "cpt_code": code}, {"action": "add", "canonical_name": "MRI", "aliases": ["mri"]}]
        (tmp_path / f"c/{k}.json").write_text(json.dumps({"expert_name": "e", "date": "d", "procedure_corrections": items}))
    vocab = vocabulary.read_vocabulary(spark, str(tmp_path / "v.csv"))
    found = {r["canonical_name"]: r for r in names.overlay(vocab, vocabulary.read_corrections(spark, str(tmp_path / "c"))).collect()}
    assert found["Blood draw"]["code"] == "2" and found["MRI"]["is_new"] and found["MRI"]["aliases"] == ["mri"]


def test_json_detection(spark):
    bodies = ['{"usdmVersion": "3", "study": {}}', '{"pages": [], "font_inventory": {}}', '{"sections": [], "protocol_id": "x"}', "{}", "not json", None]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i")
    assert [r["k"] for r in rows.select(jsons.schema_of(F.col("b")).alias("k")).collect()] == ["usdm", "formatted_doc_ir", "protocol_ir", "unknown", "unknown", "unknown"]


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "p string, v int")
    stores.save_partition(rows, str(tmp_path / "s"), "p")
    stores.save_partition(spark.createDataFrame([("b", 3)], "p string, v int"), str(tmp_path / "s"), "p")
    assert sorted((r["p"], r["v"]) for r in stores.load(spark, str(tmp_path / "s")).collect()) == [("a", 1), ("b", 3)]
    assert [r["v"] for r in stores.load(spark, str(tmp_path / "s"), "p", "b").collect()] == [3]
    for k in range(3):
        stores.append_log(spark.createDataFrame([(k,)], "n int"), str(tmp_path / "log"))
    assert [r["n"] for r in stores.tail(spark, str(tmp_path / "log"), "n int", "n", 2).collect()] == [2, 1]
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs/x.txt").write_text("a\nb")
    assert stores.read_texts(spark, str(tmp_path / "docs")).first()["text"] == "a\nb"
    assert stores.read_binaries(spark, str(tmp_path / "docs"), "*.txt").first()["length"] == 3


def test_classifiers(spark):
    rows = spark.createDataFrame([("Schedule of Activities", 0), ("Adverse events", 50), (None, 50), (None, 0)], "title string, markers int")
    t = classify.table_type(F.col("title"), F.lit(False), F.col("markers"), F.lit(60), F.lit(4), F.lit(9), F.lit(5))
    assert [tuple(r["t"]) for r in rows.select(t.alias("t")).collect()] == [("SOA", 0.9), ("OTHER", 0.8), ("SOA", 0.75), ("OTHER", 0.5)]
    words = spark.createDataFrame([("SafetyAssessmentVitalSigns",), ("Placebo-ControlledTrialOfThings",), ("short",)], "w string")
    assert [r["r"] for r in words.select(classify.run_on(F.col("w")).alias("r")).collect()] == [True, False, False]
    g = classify.grounding(F.col("w"), F.lit(2), F.lit("safety assessment"))
    assert [r["g"]["adjustment"] for r in words.select(g.alias("g")).collect()] == [0.75, 0.75, 0.75]


def test_registry_converts(spark):
    from loomgrid.functions import text
    from loomgrid.sources.registry import Registry
    from loomgrid.sources.render import to_html, to_text

    tools = Registry()
    tools.reader("text", lambda rows: rows.select("doc_id", F.posexplode(F.split("body", "\n")).alias("i", "line")))
    tools.renderer("html", lambda rows: to_text(rows, ["doc_id"], "i", "line"), priority=-1)
    tools.renderer("html", lambda rows: to_html(rows, ["doc_id"], "i", "line"))
    source = spark.createDataFrame([(1, "- a\nb & c")], "doc_id int, body string")
    step = lambda rows: rows.withColumn("line", text.line_text(F.col("line")))
    assert tools.convert(source, "text", "html", (step,)).first()["html"] == "<p>a</p><p>b &amp; c</p>"
    try:
        tools.convert(source, "pdf", "html")
    except ValueError as e:
        assert "text" in str(e)
    else:
        raise AssertionError


WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006/main"


def archive(path, parts):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def test_files_are_parsed_by_their_format(spark, tmp_path):
    from loomgrid.sources import parsers

    styles = f'<w:styles xmlns:w="{WORD}"><w:style w:styleId="Base"><w:name w:val="Base"/><w:rPr><w:b/><w:sz w:val="28"/></w:rPr></w:style><w:style w:styleId="H"><w:name w:val="heading 2"/><w:basedOn w:val="Base"/></w:style></w:styles>'
    table = '<w:tbl><w:tr><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr><w:p/></w:tc><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    body = f'<w:document xmlns:w="{WORD}"><w:body><w:p><w:pPr><w:pStyle w:val="H"/></w:pPr><w:r><w:t>Title</w:t></w:r><w:r><w:rPr><w:b w:val="0"/><w:i/><w:color w:val="FF0000"/></w:rPr><w:t> red</w:t></w:r></w:p><w:p/>{table}</w:body></w:document>'
    archive(tmp_path / "a.docx", {"word/document.xml": body, "word/styles.xml": styles})
    book = f'<workbook xmlns="{SHEET}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="r1"/></sheets></workbook>'
    cells = f'<worksheet xmlns="{SHEET}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"/><c r="C1"><v>4</v></c></row><row><c r="AB2" t="inlineStr"><is><t>in</t></is></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>'
    archive(tmp_path / "b.xlsx", {"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>', "xl/worksheets/sheet1.xml": cells, "xl/sharedStrings.xml": f'<sst xmlns="{SHEET}"><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>'})
    slide = f'<p:sld xmlns:p="p" xmlns:a="{DRAWING}"><p:sp><p:nvPr><p:ph type="title"/></p:nvPr><a:p><a:r><a:rPr b="1" sz="2000"/><a:t>Top</a:t></a:r></a:p></p:sp><p:sp><a:p><a:pPr lvl="1"/><a:r><a:t>point</a:t></a:r></a:p></p:sp><a:tbl><a:tr><a:tc gridSpan="2"><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc><a:tc hMerge="1"/></a:tr></a:tbl></p:sld>'
    archive(tmp_path / "c.pptx", {"ppt/slides/slide1.xml": slide, "ppt/slides/slide2.xml": slide.replace("Top", "Second")})
    (tmp_path / "d.txt").write_text("one\n\ntwo\fnext page")
    (tmp_path / "e.html").write_text("<h1>h</h1><p>p</p>")
    (tmp_path / "f.docx").write_text("not an archive")
    (tmp_path / "g.zzz").write_text("?")
    (tmp_path / "h.own").write_text("a|b")
    parsers.register(".own", lambda content: ((0, "body", t, 0, None, None, None, None, None, []) for t in content.decode().split("|")))
    rows = parsers.read(spark, str(tmp_path)).orderBy("path", "block").collect()
    by = lambda name: [r for r in rows if r["path"].endswith(name)]
    assert [(r["kind"], r["text"], r["row_ix"], r["col_ix"], r["rows"], r["cols"]) for r in by("a.docx")] == [("heading2", "Title red", None, None, None, None), ("cell", "a", 0, 0, 2, 1), ("cell", "b", 0, 1, 1, 2), ("cell", "c", 1, 1, 1, 1)]
    assert [(s["formats"], s["style"]) for s in by("a.docx")[0]["spans"]] == [(["bold"], "font-size: 14.0pt"), (["italic"], "color: #FF0000; font-size: 14.0pt")]
    assert [(r["text"], r["row_ix"], r["col_ix"], r["rows"], r["cols"]) for r in by("b.xlsx")] == [("shared", 0, 0, 2, 2), ("4", 0, 2, 1, 1), ("in", 1, 27, 1, 1)]
    assert [(r["page"], r["kind"], r["text"], r["depth"]) for r in by("c.pptx")][:4] == [(0, "heading1", "Top", 0), (0, "body", "point", 1), (0, "cell", "x", 0), (1, "heading1", "Second", 0)]
    assert [(r["page"], r["text"]) for r in by("d.txt")] == [(0, "one"), (0, "two"), (1, "next page")] and [r["kind"] for r in by("e.html")] == ["heading1", "body"]
    assert by("f.docx")[0]["error"].startswith("BadZipFile") and "no parser" in by("g.zzz")[0]["error"] and [r["text"] for r in by("h.own")] == ["a", "b"]
    assert [r["text"] for r in parsers.read(spark, str(tmp_path), "*.txt", (1, 1)).collect()] == ["next page"]


def test_profiles_exclusions_and_indexes(spark, tmp_path):
    (tmp_path / "general.json").write_text('{"name": "general"}')
    (tmp_path / "heart_disease.json").write_text('{"name": "heart"}')
    assert [vocabulary.load_profile(spark, str(tmp_path), a)["name"] for a in ("Heart disease", "other")] == ["heart", "general"]
    (tmp_path / "x.json").write_text('{"patterns": {"a": ["Visit ", "week"], "b": ["day"]}}')
    assert sorted(map(tuple, vocabulary.read_exclusions(spark, str(tmp_path / "x.json")).collect())) == [("day", "b"), ("visit", "a"), ("week", "a")]
    vocab = spark.createDataFrame([(1, "A", ["x", "y"]), (2, "B", ["x"])], "entry_ix long, canonical_name string, aliases array<string>")
    pick = lambda last: {r["alias"]: r["entry_ix"] for r in vocabulary.index_aliases(vocab, last).collect()}
    assert pick(False) == {"a": 1, "b": 2, "x": 1, "y": 1} and pick(True)["x"] == 2
    (tmp_path / "h.json").write_text('{"families": [{"name": "biopsy", "children": [{"name": "liver biopsy", "site": "liver"}]}]}')
    assert [tuple(r) for r in vocabulary.read_families(spark, str(tmp_path / "h.json")).collect()] == [("biopsy", "liver biopsy", "liver")]


def test_logs_are_updated_and_models_kept(spark, tmp_path):
    log = str(tmp_path / "log")
    stores.append_log(spark.createDataFrame([(1, "new"), (2, "new")], "id long, status string"), log)
    stores.update_status(spark, log, "id long, status string", "id", spark.createDataFrame([(2, "done"), (9, "x")], "id long, status string"), str(tmp_path / "log2"))
    assert sorted((r["id"], r["status"]) for r in spark.read.json(str(tmp_path / "log2")).collect()) == [(1, "new"), (2, "done")]
    for k in (1, 2):
        stores.append_csv(spark.createDataFrame([(k, 'a "b", c')], "id long, note string"), str(tmp_path / "notes"))
    assert sorted((r["id"], r["note"]) for r in spark.read.csv(str(tmp_path / "notes"), header=True, escape='"').collect()) == [("1", 'a "b", c'), ("2", 'a "b", c')]
    models = stores.Models(spark)
    models.put("m", spark.range(3))
    assert models.get("m").count() == 3 and models.names() == ["m"] and models.drop("m") and models.get("m") is None
