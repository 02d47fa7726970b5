"""A corpus pipeline of five stages over documents; each stage's rows are written and read again as the next one's.

Defined cases, of all stages: an empty table gives an empty one; columns other than those of documents don't
come out, whatever their names; rows that repeat a doc_id are rows of their own. The stages say what becomes
of null and blank texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language, lines, mixing, neardup, pieces
from tessera.llm.common import drop_stored, stored, stored_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def settled(stage: Callable) -> Callable:
    """The stage with its rows written to the shared folder; the tables it wrote on the way go."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        before = stored_tables()
        rows = stage(spark, docs, sf_dir)
        on_the_way = [t for t in stored_tables() if t not in before]
        out = stored(rows)
        drop_stored(on_the_way)
        return out

    return run_stage


def sized(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null texts too) and those that resemble no language: their score is
    under half of what nearly all labelled texts of their size reach. The label stays as given. Where no row
    teaches, nothing can be rejected and all rows stay."""
    docs = docs.select(*COLUMNS)
    prototypes = language.fit(docs)
    if not prototypes:
        return docs
    found = language.predict(docs, prototypes)
    return found.filter(language.resembles(language.score_bounds(docs, prototypes))).select(*COLUMNS)


@settled
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document left without a word goes, as do null and blank texts. Of rows with
    equal doc_ids and texts one keeps its lines."""
    return sized(lines.dedup_lines(docs.select(*COLUMNS)).filter(F.col("text").rlike(lines.WORD)))


@settled
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each class, one row of it; null texts resemble nothing and stay."""
    return neardup.keep_one(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the mix takes; a document it takes twice stands twice. Null and blank texts have no size and
    are never taken; a null source is a source of its own."""
    found = mixing.mix(docs.select(*COLUMNS))
    turns = F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))
    return found.filter("_mix_copies > 0").withColumn("_mix_turn", turns).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text again; null text: null."""
    return pieces.encode(docs.select("doc_id", "text", "lang", "source"), digests=True).drop("text", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode),
]
#: Language ID and SentencePiece can't be said in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), stored_tables()
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        drop_stored([t for t in stored_tables()[:-1] if t not in before])
    return docs
