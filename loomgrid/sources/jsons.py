"""JSON documents: detection of their schema, and studies with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Detectors by priority (fixed values): a name and the keys that a document of the schema has.
DETECTORS = [("usdm", ["usdmVersion", "study"]), ("formatted_doc_ir", ["pages", "font_inventory"]), ("protocol_ir", ["protocol_id", "sections"])]

STUDY = (
    "usdmVersion string, study struct<studyTitle: string, studyPhase: string, studyIdentifiers: array<struct<id: string>>, studyDesigns: array<struct<"
    "activities: array<struct<id: string, activityName: string>>, encounters: array<struct<id: string, encounterName: string>>, instances: array<struct<encounterId: string, activityIds: array<string>>>>>>"
)


def schema_of(body: Column) -> Column:
    """The first detector whose keys the object has, else unknown."""
    keys = F.json_object_keys(body)
    out = F.when(keys.isNull(), "unknown")
    for name, wanted in DETECTORS:
        out = out.when(F.size(F.array_except(F.array(*[F.lit(k) for k in wanted]), keys)) == 0, name)
    return out.otherwise("unknown")


def usdm_study(rows: DataFrame, body: str) -> DataFrame:
    return rows.withColumn("__s", F.from_json(body, STUDY)).select(*[c for c in rows.columns if c != body], "__s.*")


def usdm_instances(studies: DataFrame, by: list[str]) -> DataFrame:
    """A row for each activity at each encounter of the first design."""
    design = F.col("study.studyDesigns")[0]
    rows = studies.select(*by, F.explode(design["instances"]).alias("x"))
    return rows.select(*by, F.col("x.encounterId").alias("encounter"), F.explode("x.activityIds").alias("activity"))


_IR = "struct<pages:array<struct<page:bigint,blocks:array<struct<i:bigint,kind:string,text:string>>>>>"


def to_ir(blocks: DataFrame, id_: str) -> DataFrame:
    """id and ir: each document's blocks (page, i, kind, text) as JSON of pages of blocks."""
    page = blocks.groupBy(id_, "page").agg(F.array_sort(F.collect_list(F.struct("i", "kind", "text"))).alias("blocks"))
    pages = page.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("page", "blocks"))).alias("pages"))
    return pages.select(id_, F.to_json(F.struct("pages")).alias("ir"))


def blocks_of(documents: DataFrame, ir: str) -> DataFrame:
    """The other columns, and page, i, kind and text of every block of the JSON. What is no such JSON has no block."""
    rest = [c for c in documents.columns if c != ir]
    pages = documents.select(*rest, F.explode(F.from_json(ir, _IR)["pages"]).alias("p"))
    return pages.select(*rest, F.col("p.page").alias("page"), F.explode("p.blocks").alias("b")).select(*rest, "page", "b.*")
