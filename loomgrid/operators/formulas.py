"""Formula spans in texts, with offsets, by ordered patterns; overlaps are resolved by start, then length."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Formula kinds and patterns (fixed values).
PATTERNS = {
    "integral": r"∫\s*\w[\w^()+\-*/ ]*d[a-z]",
    "partial": r"∂\w+\s*/\s*∂\w+",
    "derivative": r"\bd[A-Z]\w*\s*/\s*d[a-z]\b",
    "sum": r"(?:Σ|\bsum)\s*\([^()]*\)",
    "product": r"(?:Π|\bprod)\s*\([^()]*\)",
    "limit": r"\blim\s+[a-z]\s*(?:->|→)\s*\S+",
    "combination": r"\bC\(\s*\w+\s*,\s*\w+\s*\)|\b\w+C\w\b(?=\s*=)",
    "factorial": r"\b\w+!|\(\w[\w+\-]*\)!",
    "pharmacokinetic": r"\b(?:AUC(?:0-\w+|inf|tau)?|Cmax|Tmax|t1/2|CL/F|Vd/F)\b",
    "p_value": r"\bp\s*[<>=]\s*0?\.\d+",
    "interval": r"\b\d{2}\s*%\s*CI\b",
    "power": r"\b\w\^\{?\d+\}?",
    "subscript": r"\b\w_\{?\w+\}?",
    "comparison": r"[≤≥≠≈]\s*\d+(?:\.\d+)?",
    "permutation": r"\bP\(\s*\w+\s*,\s*\w+\s*\)|\b\w+P\w\b(?=\s*=)",
    "survival": r"\bS\(t\)\s*=\s*\S+(?:\s*[*×/-]\s*\S+)*",
    "sample_size": r"\bn\s*=\s*\(?\s*Z[\w_αβ/]*[^.;]*",
    "similarity_factor": r"\bf2\s*=\s*50\s*[*×·]?\s*log[^.;]*",
    "clearance": r"\b(?:CrCl|CLcr)\s*=\s*\(?\s*140\s*[-–]\s*age[^.;]*",
    "ratio": r"\b(?:HR|OR|RR|VE)\s*=\s*\d+(?:\.\d+)?\s*%?",
    "function": r"\b(?:exp|log|ln|sqrt|log10)\s*\([^()]*\)",
    "root": r"√\s*\(?[\w^+\-*/ ]+\)?",
    "mean_deviation": r"\b\d+(?:\.\d+)?\s*±\s*\d+(?:\.\d+)?",
    "scientific": r"\b\d+(?:\.\d+)?\s*[x×]\s*10\^?\{?-?\d+\}?",
    "area_dose": r"\bmg/m(?:2|²)\b|\bmg/m²",
    "greek": r"[αβγδεζηθλμσφχψω]\s*[=<>≤≥]\s*-?\d+(?:\.\d+)?",
}
_COMPILED = [(name, re.compile(p)) for name, p in PATTERNS.items()]


def spans_of(text: str) -> list[dict]:
    """Non-overlapping formulas: by start, of equal starts the longest, of equal spans the first kind."""
    found = sorted(((m.start(), -m.end(), rank, name) for rank, (name, p) in enumerate(_COMPILED) for m in p.finditer(text)))
    out, last = [], 0
    for start, end, _, name in found:
        if start >= last:
            last = -end
            out.append({"kind": name, "start": start, "end": last})
    return out


def annotated(text: str) -> str:
    """The text as HTML with its formulas marked; marks are spliced from the end, so offsets hold."""
    for f in reversed(spans_of(text)):
        text = f'{text[: f["start"]]}<span class="formula" data-kind="{f["kind"]}">{text[f["start"] : f["end"]]}</span>{text[f["end"] :]}'
    return text


def annotate(rows: DataFrame, column: str, to: str) -> DataFrame:
    @F.pandas_udf("string")
    def mark(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else annotated(t))

    return rows.withColumn(to, mark(F.col(column)))


def detect(rows: DataFrame, column: str) -> DataFrame:
    """rows with formulas: kind, start and end of each."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def find(texts: pd.Series) -> pd.Series:
        return pd.Series([spans_of(t or "") for t in texts])

    return rows.withColumn("formulas", find(F.col(column)))
