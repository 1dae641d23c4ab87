"""Vocabulary files, exclusion patterns, hierarchies and configurations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "canonical_name string, cpt_code string, code_system string, category string, cost_tier string, aliases string"
TIERS = ["LOW", "MEDIUM", "HIGH", "VERY_HIGH"]


def read_vocabulary(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """A CSV of entries: `#` lines are left out, aliases are split and lower-cased, an unknown cost tier is LOW.

    entry_ix numbers the entries by name; of rows with one name the smallest counts.
    """
    rows = spark.read.csv(path, header=True, schema=SCHEMA, comment="#", multiLine=True, escape='"')
    named = rows.where(F.trim("canonical_name") != "").withColumn("canonical_name", F.trim("canonical_name"))
    aliases = F.filter(F.transform(F.split(F.coalesce("aliases", F.lit("")), f"[{separator}]"), lambda a: F.lower(F.trim(a))), lambda a: a != "")
    one = named.groupBy("canonical_name").agg(F.min(F.struct("cpt_code", "code_system", "category", "cost_tier", "aliases")).alias("m")).select("canonical_name", "m.*")
    tier = F.when(F.trim("cost_tier").isin(*TIERS), F.trim("cost_tier")).otherwise("LOW")
    return one.select(F.xxhash64("canonical_name").alias("entry_ix"), "canonical_name", F.nullif(F.trim("cpt_code"), F.lit("")).alias("code"), F.coalesce("category", F.lit("Unknown")).alias("category"), tier.alias("cost_tier"), aliases.alias("aliases"))


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    rows = vocabulary.select("canonical_name", F.col("code").alias("cpt_code"), F.lit("CPT").alias("code_system"), "category", "cost_tier", F.array_join("aliases", ", ").alias("aliases"))
    rows.write.mode("overwrite").csv(path, header=True, escape='"')


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """Expert corrections in JSON files, later file names last: canonical_name, action, code, aliases, pos."""
    schema = "expert_name string, date string, procedure_corrections array<struct<action:string,canonical_name:string,cpt_code:string,add_aliases:array<string>,aliases:array<string>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).withColumn("file", F.input_file_name())
    items = rows.select("file", F.posexplode("procedure_corrections").alias("i", "c"))
    pos = F.concat_ws("|", "file", F.lpad(F.col("i").cast("string"), 8, "0"))
    return items.select("c.canonical_name", "c.action", F.col("c.cpt_code").alias("code"), F.coalesce("c.add_aliases", "c.aliases", F.array().cast("array<string>")).alias("aliases"), pos.alias("pos"))


def read_families(spark: SparkSession, path: str) -> DataFrame:
    """family, child, site of a JSON of families."""
    schema = "families array<struct<name:string,children:array<struct<name:string,site:string>>>>"
    rows = spark.read.json(path, schema=schema, multiLine=True).select(F.explode("families").alias("f"))
    return rows.select(F.col("f.name").alias("family"), F.explode("f.children").alias("c")).select("family", F.col("c.name").alias("child"), F.col("c.site").alias("site"))


def resolve_config(candidates: list[str], existing: set[str], default: str = "_defaults") -> str:
    return next((c for c in candidates if c in existing), default)


def index_aliases(vocabulary: DataFrame, last_wins: bool = False) -> DataFrame:
    """alias and entry_ix: of entries that share an alias the first (by entry_ix), or the last, counts."""
    every = vocabulary.select("entry_ix", F.explode(F.array_union(F.array(F.lower("canonical_name")), "aliases")).alias("alias"))
    return every.groupBy("alias").agg((F.max if last_wins else F.min)("entry_ix").alias("entry_ix"))


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """pattern and group of a JSON of lists of patterns, in small letters."""
    rows = spark.read.json(path, schema="patterns map<string,array<string>>", multiLine=True)
    return rows.select(F.explode("patterns").alias("group", "p")).select("group", F.explode("p").alias("pattern")).select(F.lower(F.trim("pattern")).alias("pattern"), "group").distinct()


def load_profile(spark: SparkSession, folder: str, area: str, default: str = "general") -> dict:
    """A therapeutic area's profile, a JSON file of the folder, or the default's where there is none. Read on the driver, as a configuration."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in (area.lower().replace(" ", "_"), default):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.json")
        if path.getFileSystem(conf).exists(path):
            return json.loads(spark.read.text(str(path), wholetext=True).first()["value"])
    raise FileNotFoundError(f"neither {area} nor {default} in {folder}")
