"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablelens.llm import repeats, severity
from tablelens.llm.chosen_path import JOIN_SQL, similarity_classes
from tablelens.llm.common import pin_batches
from tablelens.llm.html_text import extract_main_text
from tablelens.llm.infilling import FILL_SQL, digest, fill_in_middle
from tablelens.llm.kdtree import NEAREST_SQL, quantised, top_products
from tablelens.llm.mixing import MIX_SQL, mix_sources
from tablelens.llm.packing import pack
from tablelens.llm.passages import quality_scores
from tablelens.llm.phrases import fingerprint_with_edits
from tablelens.llm.spelling import NOISE, group_spellings, word_counts
from tablelens.llm.token_counts import count_tokens
from tablelens.llm.warc import ARCHIVE_SQL, read_archives, write_archives
from tablelens.session import pin_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Register ``function(*tables)`` under ``name``, with the SQL that must give the same rows."""

    def register(function: Callable[..., DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            pin_batches(pin_session(spark))
            return function(*(spark.read.parquet(f"{folder}/{table}.parquet") for table in tables))

        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_html_extraction", "pages")
def op1(pages: DataFrame) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


@query("op2_phrase_fingerprints", "documents")
def op2(documents: DataFrame) -> DataFrame:
    """Lempel-Ziv fingerprints of every text, its edited text and its successor."""
    return fingerprint_with_edits(documents)


@query("op3_exact_top_k", "embeddings", sql=NEAREST_SQL)
def op3(embeddings: DataFrame) -> DataFrame:
    """The five largest integer inner products for every 50th vector."""
    points = quantised(embeddings)
    return top_products(points, points.where("vec_id % 50 = 0"))


@query("op4_poisson_mixing", "documents", sql=MIX_SQL)
def op4(documents: DataFrame) -> DataFrame:
    """All documents replicated to tempered source weights and shuffled."""
    return mix_sources(documents)


@query("op5_warc_archives", "pages", sql=ARCHIVE_SQL)
def op5(pages: DataFrame) -> DataFrame:
    """Every page written to dictionary-compressed archives and read back."""
    records = read_archives(*write_archives(pages), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_passage_quality", "documents", "labels")
def op6(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every document by attention over its passages."""
    return quality_scores(documents, labels)


@query("op7_harmonic_packing", "documents")
def op7(documents: DataFrame) -> DataFrame:
    """Every document packed into sequences of 2048 tokens."""
    return pack(documents)


@query("op8_chosen_path_join", "documents", sql=JOIN_SQL)
def op8(documents: DataFrame) -> DataFrame:
    """Classes and links of documents with similar word shingles."""
    return similarity_classes(documents).select("doc_id", "class_id", "copy_of", "links")


@query("op9_toxic_severity", "documents", "labels")
def op9(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Expected severity of every document."""
    scored = severity.score_severity(documents, severity.train(documents, labels))
    rejected = (F.col("severity") >= severity.REJECT).cast("int")
    return scored.select("doc_id", "p_mild", "p_severe", "severity", rejected.alias("rejected"))


@query("op10_token_counts", "documents")
def op10(documents: DataFrame) -> DataFrame:
    """Tokens of every text by counts of its pre-tokens."""
    return count_tokens(documents)


@query("op11_fill_in_middle", "documents", sql=FILL_SQL)
def op11(documents: DataFrame) -> DataFrame:
    """Every text cut at two line ends, its middle moved to the end, as digests."""
    return digest(fill_in_middle(documents))


@query("op12_suffix_dedup", "documents", sql=repeats.REPEAT_SQL)
def op12(documents: DataFrame) -> DataFrame:
    """Every text without the bytes of 100-byte strings that start earlier in the corpus."""
    return repeats.digest(repeats.remove_repeats(documents.select("doc_id", "text"), with_text=False))


@query("op13_spelling_variants", "documents")
def op13(documents: DataFrame) -> DataFrame:
    """Words of all texts, some of them misspelt by a hash, with the words they are variants of."""
    return group_spellings(word_counts(documents, noise=NOISE))
