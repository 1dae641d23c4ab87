"""Tables of protocols, knowledge elements, logs and results: partitioned by document, replaced or appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_partition(rows: DataFrame, path: str, by: str) -> None:
    """The partitions that rows have, replaced; the others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def load(spark: SparkSession, path: str, by: str | None = None, value: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if by is None else rows.where(F.col(by) == value)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def tail(spark: SparkSession, path: str, schema: str, order: str, n: int) -> DataFrame:
    return spark.read.schema(schema).json(path).orderBy(F.desc(order)).limit(n)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole files of a folder, for batch imports."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length and content of files that a parser of their format takes from here."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def update_status(spark: SparkSession, path: str, schema: str, key: str, changes: DataFrame, to: str) -> None:
    """The log at path with the changed records' columns replaced, written to another path: a log is never read and overwritten at once."""
    rows = spark.read.schema(schema).json(path)
    fields = [c for c in changes.columns if c != key]
    joined = rows.join(changes.withColumnsRenamed({c: f"__{c}" for c in fields}).withColumn("__hit", F.lit(True)), key, "left")
    kept = joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
    kept.write.mode("overwrite").json(to)


def append_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").csv(path, header=True, escape='"')


class Models:
    """Named models of a session as temporary views: put, get, list and drop."""

    def __init__(self, spark: SparkSession, prefix: str = "model_"):
        self.spark, self.prefix = spark, prefix

    def put(self, name: str, rows: DataFrame) -> None:
        rows.createOrReplaceTempView(self.prefix + name)

    def get(self, name: str) -> DataFrame | None:
        return self.spark.table(self.prefix + name) if self.spark.catalog.tableExists(self.prefix + name) else None

    def names(self) -> list[str]:
        return sorted(t.name.removeprefix(self.prefix) for t in self.spark.catalog.listTables() if t.isTemporary and t.name.startswith(self.prefix))

    def drop(self, name: str) -> bool:
        return self.spark.catalog.dropTempView(self.prefix + name)
