"""The corpus pipeline: five stages over documents, each written to the shared folder and read again.

1. toxicity: documents with a score of 0.5 or more go.
2. line dedup: lines that an earlier document has go. A document that loses all its lines, or all but blank ones, is a
   copy of what others keep and goes; documents that were empty or blank before stay.
3. near dedup: of each class of near duplicates the smallest doc_id stays.
4. decontamination: documents with a word inside an exact benchmark window go.
5. packing: the rest as pieces in sequences.

Defined results. Null and empty texts pass the first four stages and are packed as their end mark. A row without a doc_id
passes them too, and is judged by its own text. Rows that share a doc_id are one document for line and near dedup. Empty
tables give no rows. Columns beside those of documents pass the first four stages, but for n_words, n_hit, n_lines,
n_dropped, items, near_items, contaminated, score, offending and class_id, which the stages use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm._shared import staged, table
from loomgrid.llm.decontam import contamination
from loomgrid.llm.linededup import BLANKS, dedup_lines
from loomgrid.llm.neardup import one_of_each_class
from loomgrid.llm.packing import pack
from loomgrid.llm.queries import tokenizer_path
from loomgrid.llm.toxicity import fit, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where("score < 0.5").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("text", F.lit(BLANKS)) == "")
    return kept.where(~emptied | F.col("text").isNull()).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The stages' models, samples and token ids have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
