"""From raw documents to packed training sequences."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tablelens.llm import passages, severity
from tablelens.llm.chosen_path import similarity_classes
from tablelens.llm.common import pin_batches, written
from tablelens.llm.mixing import mix_sources
from tablelens.llm.packing import pack

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # SQL cannot express the learned stages


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _shielded(stage):
    """Give columns besides those of ``documents`` other names inside a stage, so that no operator's column meets them."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        given = docs.columns
        own = {name: f"carried_column_{place}" for place, name in enumerate(given) if name not in COLUMNS}
        result = stage(spark, docs.withColumnsRenamed(own), sf_dir)
        return result.withColumnsRenamed({new: old for old, new in own.items()}).select(*[F.col(f"`{name}`") for name in given])

    return run_stage


@_shielded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity stays below 0.25."""
    scored = severity.score_severity(docs, severity.train(docs, _labels(spark, sf_dir)))
    return scored.where(F.col("severity") < severity.REJECT).select(*docs.columns)


@_shielded
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7."""
    scored = passages.score_quality(docs, passages.train(docs, _labels(spark, sf_dir)), name="quality_score")
    return scored.where(F.col("quality_score") >= passages.KEEP).select(*docs.columns)


@_shielded
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of linked documents the one with the smallest id; of its repeated rows, one."""
    classes = similarity_classes(docs)
    stands = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key"))
    first = classes.where(stands).select(
        F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")
    ).distinct()
    keyed = docs.withColumn("text_key", F.md5(F.coalesce("text", F.lit(""))))
    kept = keyed.join(first, keyed["doc_id"].eqNullSafe(first["kept_id"]) & (keyed["text_key"] == first["kept_key"]), "left_semi")
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("source"))
    return kept.withColumn("turn", turn).where("turn = 1").select(*docs.columns)


@_shielded
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to tempered source weights, in a global random order."""
    return mix_sources(docs).select(*docs.columns)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document in sequences of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources", mix),
    ("packing", pack_documents),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = pin_batches(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = written(docs, f"stage-{place}")
    return docs
