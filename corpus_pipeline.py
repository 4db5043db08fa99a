"""From raw documents to packed training sequences: each stage calls one operator and works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.llm import decontaminate, language, packing, quality, simhash
from ledgerlane.llm.common import prepare, stored, whole_row

ORACLE_SQL = None  # models, tokens and a curve are beyond SQL; tests compare with brute-force versions


def _carried(docs: DataFrame) -> DataFrame:
    """The operator's columns, and the whole row beside them whatever its columns are called."""
    return docs.select("doc_id", "text", whole_row(docs).alias("document"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter, and texts that no learnt language explains nearly as well as its own texts.

    Null and empty texts have no letter; repeated rows are judged alike; null ids and languages are allowed (a row
    without language is not learnt from); of two languages that explain a text alike the first by name counts;
    all columns are kept, whatever their names; an empty table stays empty, and without learnt languages no row passes.
    """
    prepare(spark)
    model = language.fit(language.counting_rows(docs))
    found = language.identify(_carried(docs), model, keep=("document",)).filter("entropy is not null")
    limits = stored(language.rejection_limits(language.calibration_rows(docs), model))  # a row per language
    judged = found.join(F.broadcast(limits), found["lang_pred"] == limits["lang"], "left")
    return judged.filter(language.explained(F.col("entropy"), F.col("document.text"))).select("document.*")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose calibrated score calls label 0 likelier.

    Null and empty texts are scored like any other; a score of exactly 0.5 passes, so without labels all do;
    repeated rows are judged alike, null ids are kept; all columns are kept; an empty table stays empty.
    """
    prepare(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(_carried(docs), labels, keep=("document",)).filter("predicted = 1").select("document.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the least id (nulls last), then of the least text hash.

    Null, empty and blank texts are one group; repeated rows leave one; all columns are kept, whatever their names; an
    empty table stays empty.
    """
    prepare(spark)
    return simhash.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or a whole shorter one.

    Null and empty texts hold nothing and stay; repeated rows and null ids are kept; null or wordless items hit
    nothing; all columns are kept; an empty table stays empty.
    """
    prepare(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_benchmark(_carried(docs), benchmark, keep=("document",))
    return found.filter(~F.col("contaminated")).select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens along the curve.

    Null and empty texts are the end id alone; ties on the curve are ordered by id, then size; repeated rows are packed each;
    an empty table gives no piece.
    """
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("language", identify_language), ("quality", classify_quality), ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
