"""Expressions on lines and texts: styles, headings, references, cleaning, formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of line styles, headings and references.
HEADING = r"^([0-9]+(?:\.[0-9]+)*)\.?\s+(.+)$"
BULLET = r"^\s*[-*]\s+(.+)$"
NUMBERED = r"^\s*[0-9]{1,3}[.)]\s+(.+)$"
SECTION = r"^([0-9]{1,2}(?:\.[0-9]{1,3}){0,4})\.?\s+([A-Z][A-Za-z\s,/&():;'\"-]+)"
TOC = r"([0-9]{1,2}(?:\.[0-9]{1,3}){0,4})\.?\s+([A-Za-z][A-Za-z\s,/&()-]+?)\s*[.·_-]{3,}\s*([0-9]{1,4})\s*$"
SECTION_LETTER = r"^([A-Z](?:\.[0-9]{1,3}){0,3})\.?\s+([A-Z][A-Za-z\s,/&():;'\"-]+)"
SECTION_ROMAN = r"^((?:IX|IV|V?I{1,3}|VI{1,3}|X{1,3})(?:\.[0-9]{1,3}){0,3})\.?\s+([A-Z][A-Za-z\s,/&():;'\"-]+)"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
MONTH_WORDS = r"(?i)^(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)(\s|$)"
MATH = "=±×÷√∑∏∫≤≥≠≈∈∞αβγδεζηθλμσφχψω²³⁻¹"
EQUATION_SIGNS = [r"[=≈≤≥]", r"[±√∑∏∫]", r"[αβγδσμ]", r"\^[0-9{]", r"_[0-9{]", r"\\frac", r"\bexp\b", r"\blog\b", r"\bln\b", r"[²³⁻¹⁺]", r"\bCI\s*=", r"\bn\s*=", r"\bHR\s*=", r"\bp\s*[<>=]", r"Z[_α]"]
#: Words that speak for a domain, in the order that decides between domains of as many (fixed values).
DOMAINS = {
    "oncology": [
        "tumor", "tumour", "RECIST", "cycle", "C1D1", "chemotherapy", "immunotherapy", "progression", "response assessment", "ECOG", "dose escalation", "DLT", "MTD", "ORR", "PFS", "OS", "nivolumab", "pembrolizumab",
        "atezolizumab", "durvalumab", "biopsy", "ctDNA", "PD-L1",
    ],
    "hematology": ["bone marrow", "CAR-T", "leukapheresis", "lymphodepletion", "CRS", "cytokine release", "engraftment", "MRD", "venetoclax", "ramp-up", "TLS", "tumor lysis"],
    "vaccines": ["vaccination", "immunogenicity", "seroconversion", "GMT", "antibody titer", "reactogenicity", "e-diary", "booster", "adjuvant", "antigen", "dose 1", "dose 2"],
    "cardiology": ["echocardiogram", "LVEF", "NT-proBNP", "BNP", "6MWD", "KCCQ", "NYHA", "heart failure", "ejection fraction", "MACE", "cardiovascular"],
    "autoimmune": ["DAS28", "ACR20", "CDAI", "SDAI", "HAQ-DI", "PASI", "IGA", "EASI", "endoscopy", "Mayo score", "calprotectin", "rheumatoid", "psoriasis", "colitis"],
    "pk_intensive": ["pre-dose", "post-dose", "Cmax", "AUC", "trough", "dense PK", "sparse PK", "dose escalation", "0.5h", "1h", "2h", "4h", "8h", "12h", "24h", "sentinel", "cohort", "MAD", "SAD"],
    "respiratory": ["FEV1", "spirometry", "FeNO", "eosinophil", "asthma", "COPD", "exacerbation", "SGRQ", "ACQ"],
    "infectious_disease": ["viral load", "CD4", "HIV", "HBV", "HCV", "hepatitis", "seroconversion", "antiretroviral", "PrEP"],
    "dermatology": ["PASI", "IGA", "EASI", "BSA", "pruritus", "NRS", "atopic", "psoriasis", "eczema"],
    "ophthalmology": ["BCVA", "OCT", "intravitreal", "macular", "retinal", "IOP", "fundoscopy", "aflibercept", "ranibizumab"],
}
#: Words of rows that belong to a schedule of drug levels, of all domains' profiles (fixed values).
LEVEL_WORDS = [
    "PK sample", "Pharmacokinetic", "Ctrough", "Cmax", "AUC", "Pre-dose", "Post-dose", "trough", "sparse PK", "dense PK", "Immunogenicity sample", "ADA", "Anti-drug antibody", "Immunogenicity", "Antibody titer",
    "Seroconversion", "GMT", "Geometric mean titer", "Fold-rise", "Neutralizing antibody", "Binding antibody", "PK", "Tmax", "t1/2", "Dense sampling", "Sparse sampling", "0h", "0.5h", "1h", "2h", "4h", "8h", "12h", "24h",
    "Urine collection", "Drug level", "Trough concentration",
]


def is_level_row(name: Column) -> Column:
    """Whether a row's name has a word of drug level schedules."""
    low, hit = F.lower(name), F.lit(False)
    for w in LEVEL_WORDS:
        hit = hit | F.contains(low, F.lit(w.lower()))
    return hit


def line_style(line: Column) -> Column:
    """heading1 to heading4 by the number's dots, list_bullet, list_number or body."""
    dots = F.length(F.regexp_extract(line, HEADING, 1)) - F.length(F.replace(F.regexp_extract(line, HEADING, 1), F.lit("."), F.lit("")))
    heading = F.when(dots == 0, "heading1").when(dots == 1, "heading2").when(dots == 2, "heading3").otherwise("heading4")
    return F.when(line.rlike(HEADING), heading).when(line.rlike(BULLET), "list_bullet").when(line.rlike(NUMBERED), "list_number").otherwise("body")


def line_text(line: Column) -> Column:
    """The line without its list mark."""
    style = line_style(line)
    return F.when(style == "list_bullet", F.regexp_extract(line, BULLET, 1)).when(style == "list_number", F.regexp_extract(line, NUMBERED, 1)).otherwise(line)


def markdown_block(line: Column) -> Column:
    """rule, heading1.., table, quote, list_bullet, list_number, code, blank or body."""
    level = F.length(F.regexp_extract(line, r"^(#{1,6})\s+", 1)).cast("string")
    return (
        F.when(F.trim(line) == "", "blank").when(line.rlike(r"^\s*(-{3,}|\*{3,}|_{3,})\s*$"), "rule").when(line.rlike(r"^#{1,6}\s+"), F.concat(F.lit("heading"), level)).when(line.rlike(r"^\s*\|.*\|\s*$"), "table")
        .when(line.rlike(r"^\s*>"), "quote").when(line.rlike(r"^\s*[-*+]\s+"), "list_bullet").when(line.rlike(r"^\s*[0-9]+[.)]\s+"), "list_number").when(line.rlike(r"^\s*```"), "code").otherwise("body")
    )


def inline_html(text: Column) -> Column:
    """Markdown's bold, italic and code as tags."""
    v = F.regexp_replace(text, r"\*\*([^*]+)\*\*", "<b>$1</b>")
    v = F.regexp_replace(v, r"\*([^*]+)\*", "<i>$1</i>")
    return F.regexp_replace(v, "`([^`]+)`", "<code>$1</code>")


def strip_html(html: Column) -> Column:
    """Visible text: without scripts, styles, comments and tags, entities resolved, white space collapsed."""
    v = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    v = F.regexp_replace(F.regexp_replace(v, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        v = F.replace(v, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(v, r"[ \t\n\r\f]+", " "))


def escape_html(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def section_heading(line: Column) -> Column:
    """STRUCT<number, title> of a numbered, lettered or roman heading; null for dates and titles of fewer than three letters."""
    patterns = [SECTION, SECTION_LETTER, SECTION_ROMAN]
    number, title = (F.coalesce(*[F.when(line.rlike(p), F.regexp_extract(line, p, k)) for p in patterns]) for k in (1, 2))
    title = F.trim(F.regexp_replace(title, r"[ \t\n\r\f]+$", ""))
    return F.when(number.isNotNull() & ~title.rlike(MONTH_WORDS) & (F.length(title) >= 3), F.struct(number.alias("number"), title.alias("title")))


#: Abbreviations of procedures (fixed values).
ABBREVIATIONS = {
    "ecg": "electrocardiogram", "ekg": "electrocardiogram", "bp": "blood pressure", "hr": "heart rate", "bmi": "body mass index", "cbc": "complete blood count", "cmp": "comprehensive metabolic panel",
    "bmp": "basic metabolic panel", "ua": "urinalysis", "ct": "computed tomography", "mri": "magnetic resonance imaging", "pet": "positron emission tomography", "us": "ultrasound", "xr": "x-ray",
    "pfts": "pulmonary function tests", "pft": "pulmonary function test", "lfts": "liver function tests", "lft": "liver function test", "hba1c": "hemoglobin a1c", "a1c": "hemoglobin a1c",
    "inr": "international normalized ratio", "pt": "prothrombin time", "aptt": "activated partial thromboplastin time", "esr": "erythrocyte sedimentation rate", "crp": "c-reactive protein",
    "gfr": "glomerular filtration rate", "egfr": "estimated glomerular filtration rate", "dexa": "dual-energy x-ray absorptiometry", "echo": "echocardiogram", "holter": "holter monitor", "aes": "adverse events",
    "sae": "serious adverse event", "pk": "pharmacokinetic", "pd": "pharmacodynamic", "conmeds": "concomitant medications",
}


def expanded(name: Column) -> Column:
    """A name in small letters, its words apart by one blank, abbreviations written out."""
    words = F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda w: w != "")
    known = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), w)), " ")


def word_set(text: Column) -> Column:
    """The distinct words of more than one letter or digit, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 1)))


def parent_number(number: Column) -> Column:
    return F.when(F.contains(number, F.lit(".")), F.regexp_replace(number, r"\.[^.]+$", ""))


def next_sibling(number: Column) -> Column:
    """2.2.1 to 2.2.2."""
    parts = F.split(number, r"\.")
    last = (F.element_at(parts, -1).cast("int") + 1).cast("string")
    return F.array_join(F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(last)), ".")


def level_of(number: Column) -> Column:
    return F.size(F.split(number, r"\."))


def base_title(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(title, r"(?i)\s*[-–(]*\s*(continued|cont\.?|cont'd)\s*\)?\s*$", "")))


def fingerprint(text: Column) -> Column:
    """A header or footer's text in small letters without its page number, white space collapsed."""
    v = F.regexp_replace(F.lower(F.trim(text)), r"\bpage\s*[0-9]+\b", "")
    return F.trim(F.regexp_replace(v, r"[ \t\n\r\f]+", " "))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def looks_like_equation(text: Column) -> Column:
    signs = F.length(text) - F.length(F.translate(text, MATH, ""))
    hits = sum((text.rlike(p).cast("int") for p in EQUATION_SIGNS), F.lit(0))
    return F.length(text).between(3, 200) & ((signs >= 3) | (hits >= 3))


def auto_link(text: Column) -> Column:
    """References to sections, tables, figures and appendices as links."""
    for word, number in (("section", r"[0-9]{1,2}(?:\.[0-9]{1,3}){0,4}"), ("table", r"[0-9]{1,3}(?:\.[0-9]{1,2})?"), ("figure", r"[0-9]{1,3}(?:\.[0-9]{1,2})?"), ("appendix", r"[A-Z0-9]{1,3}")):
        link = rf'$1<a href="#{word}-$3" class="cross-ref" data-ref-type="{word}" data-ref="$3">$2$3</a>'
        text = F.regexp_replace(text, rf"(^|[^\"\w])([{word[0].upper()}{word[0]}]{word[1:]}\s+)({number})", link)
    return F.regexp_replace(text, r"(^|[^\"\w=])(https?://[^\s<>\"')\]]+)", '$1<a href="$2" target="_blank" rel="noopener" class="external-link">$2</a>')


def color_parts(color: Column) -> Column:
    """STRUCT<r, g, b> of a packed colour."""
    byte = lambda n: F.shiftright(color, n).bitwiseAND(255)
    return F.struct(byte(16).alias("r"), byte(8).alias("g"), byte(0).alias("b"))


#: Named colours, packed (fixed values).
COLORS = {
    "black": 0x000000, "white": 0xFFFFFF, "red": 0xFF0000, "green": 0x008000, "blue": 0x0000FF, "yellow": 0xFFFF00, "gray": 0x808080, "grey": 0x808080, "orange": 0xFFA500, "purple": 0x800080, "navy": 0x000080,
    "teal": 0x008080,
}
#: What a font's name loses for its family, in this order (fixed values).
FONT_SUFFIXES = ["-Bold", "-Italic", "-BoldItalic", "MT", "PS", ",Bold", ",Italic", ",BoldItalic", "-Regular"]
DEFAULT_SIZE = 12.0


def css_value(style: Column, name: str) -> Column:
    """The last value that a style text gives to the property, or null."""
    pairs = F.filter(F.split(style, ";"), lambda d: F.contains(d, F.lit(":")))
    own = F.filter(pairs, lambda d: F.lower(F.trim(F.split_part(d, F.lit(":"), F.lit(1)))) == name)
    return F.when(F.size(own) > 0, F.trim(F.regexp_replace(F.element_at(own, -1), "^[^:]*:", "")))


def css_color(value: Column) -> Column:
    """The packed colour of #rrggbb, #rgb, rgb(r, g, b) or a name; else null."""
    v = F.lower(F.trim(value))
    part = lambda i: F.regexp_extract(v, r"^rgb\(\s*([0-9]+)\s*,\s*([0-9]+)\s*,\s*([0-9]+)\s*\)$", i).try_cast("int")
    six = F.conv(F.regexp_extract(v, "^#([0-9a-f]{6})$", 1), 16, 10).try_cast("int")
    three = F.conv(F.regexp_replace(F.regexp_extract(v, "^#([0-9a-f]{3})$", 1), "(.)", "$1$1"), 16, 10).try_cast("int")
    named = F.create_map(*[F.lit(x) for kv in COLORS.items() for x in kv])
    return F.when(v.rlike("^#[0-9a-f]{6}$"), six).when(v.rlike("^#[0-9a-f]{3}$"), three).when(v.startswith("rgb("), F.shiftleft(part(1), 16).bitwiseOR(F.shiftleft(part(2), 8)).bitwiseOR(part(3))).otherwise(F.try_element_at(named, v))


def css_size(value: Column) -> Column:
    """A font size in points; em and rem are of the default size."""
    v = F.lower(F.trim(value))
    n = lambda unit: F.regexp_extract(v, rf"^([0-9.]+)\s*{unit}$", 1).try_cast("double")
    return F.coalesce(n("pt"), n("px") * 0.75, n("em") * DEFAULT_SIZE, n("rem") * DEFAULT_SIZE)


def font_family(name: Column) -> Column:
    for suffix in FONT_SUFFIXES:
        name = F.replace(name, F.lit(suffix), F.lit(""))
    return F.trim(name)


#: Signs that begin an item within a table cell (fixed values).
CELL_BULLETS = "\u25a0\u25aa\u25cf\u2022\u2023\u25e6\u2043\uf0b7\uf0a7\u25cb"


def cell_html(text: Column) -> Column:
    """A cell's text as HTML: items after bullets as a list, lines by line breaks."""
    safe = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    parts = lambda pattern: F.filter(F.transform(F.split(safe, pattern), lambda x: F.btrim(x, F.lit(" \t\n\r\f"))), lambda x: x != "")
    items, lines_ = parts(f"[{CELL_BULLETS}]\\s*"), parts("\n")
    listed = F.concat(F.lit("<ul>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""), F.lit("</ul>"))
    return F.when(safe.rlike(f"[{CELL_BULLETS}]") & (F.size(items) > 1), listed).when(safe.contains("\n") & (F.size(lines_) > 1), F.array_join(lines_, "<br>")).otherwise(safe)


def fill_placeholders(text: Column, values: Column) -> Column:
    """{{key}} by the map's values."""
    return F.aggregate(F.map_entries(values), text, lambda acc, kv: F.replace(acc, F.concat(F.lit("{{"), kv["key"], F.lit("}}")), kv["value"]))


def salvage_json(text: Column) -> Column:
    """The JSON of a reply: as it is, within a fence, or from the first brace to the last; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    usable = lambda x: F.when(F.get_json_object(x, "$").isNotNull(), x)
    return F.coalesce(usable(F.trim(text)), usable(fenced), usable(braces))


def domain_of(text: Column) -> Column:
    """The domain with the most keyword hits; the first listed of equal ones, general without any."""
    low = F.lower(text)
    scored = [F.struct(sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(DOMAINS.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def style_score(size: Column, body: Column, bold: Column, text: Column, gap: Column) -> Column:
    """How much a paragraph looks like a heading: size, weight, brevity, number, capitals, space above."""
    letters = F.regexp_replace(text, "[^A-Za-z]", "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", "")) / F.greatest(F.length(letters), F.lit(1))
    bigger = F.when(size >= body * 1.5, 3).when(size >= body * 1.2, 2).when(size > body * 1.05, 1).otherwise(0)
    return bigger + F.when(bold, 2).otherwise(0) + F.when(F.size(F.split(F.trim(text), r"\s+")) <= 15, 1.5).otherwise(0) + F.when(text.rlike(HEADING), 2.5).otherwise(0) + F.when((F.length(letters) > 3) & (capitals > 0.8), 1).otherwise(0) + F.when(gap > 15, 0.5).otherwise(0)
