"""A corpus from raw documents to packed sequences: five stages, each by an operator of `taskloom.llm`.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a frame. `run` writes each as Parquet into
the shared folder and reads it back as the next one's documents. Null ids and texts, empty tables, repeated rows and further
columns are handled as the operators' docstrings say; all stages but the last return the columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import langid, packing, simhash, toxicity, winnowing
from taskloom.llm.common import crc_mod, read_table
from taskloom.session import configure, scratch_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest window scores below one half; learns from all labelled rows of the raw table outside the held-out fold."""
    labels = read_table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    network = toxicity.train(read_table(spark, sf_dir, "documents"), labels)
    return toxicity.without_toxic(docs, network)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, in a language that the labelled text teaches; longer ones that no language fits by the bits of held-out
    labelled text go. Words and limits are counted over whole texts of all labelled rows. The declared language of a document is not
    looked at."""
    held = crc_mod("doc_id", 3) == 1
    parser = langid.train_on_all(docs.where(~held))
    return langid.in_languages(docs, parser, most=langid.limits(docs.where(held), parser))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, of the least id: linked at a Jaccard likeness of 0.8 or more over five-word
    shingles, and at three or fewer differing bits of the operator's fingerprints."""
    return simhash.deduplicated(docs, similar=True)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten benchmark words."""
    return winnowing.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in sequences of 1,024 to 8,192 bytes."""
    return packing.packed(docs, F.coalesce(F.octet_length("text"), F.lit(0)) + 1)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("near duplicates", duplicates_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: The first stage is learnt, and sequences are packed one piece after the other: SQL can't say that. Tests hold each stage against
#: a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of a folder."""
    docs = read_table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
