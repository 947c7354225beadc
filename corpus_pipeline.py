"""From raw documents to token ids: toxicity, near duplicates, secrets, source mix, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents.  Stages
tell rows apart by their place in the scan of the Parquet table before them, so repeated rows and missing ids are safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftgraph.llm import bpe, jaccard, mixing, secrets, toxicity
from weftgraph.llm.common import materialize

#: SQL has no language models, signature trees or tokenizers; tests hold run() against a brute-force version.
ORACLE_SQL = None
ROW = "__weft_row"


def _with_row(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.scored(docs, labels, column="__weft_toxic")
    return scored.where(F.col("__weft_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at 0.8 or more of their five-word shingles the first stays."""
    rows = _with_row(docs)
    groups = jaccard.grouped(rows.select(F.col(ROW).alias("doc_id"), "text"))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become a mark; n_chars follows the text."""
    return secrets.redact_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words: whole times, and once more by a hash for the rest.  Documents
    without words stay once."""
    rows = _with_row(docs)
    mix = mixing.mix(rows.select(F.col(ROW).alias("doc_id"), "source", "text"))
    rest = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.floor(F.col("taken") / F.col("size") + rest)).cast("int")
    taken = mix.select(F.col("doc_id").alias(ROW), times.alias("__weft_times")).where("__weft_times > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("__weft_times")))
    return rows.join(taken, ROW).withColumn("__weft_copy", copies).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of what they decode to."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
