"""The corpus pipeline: five stages from documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet in the session's shared
folder and read again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkdossier.llm import jaccard_join, mixing, packing, quality_classifier, quality_rules
from sparkdossier.session import scratch


def tokenizer_path() -> str:
    """Where the installed public vocabulary file is; executors have the same installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the quality classifier rejects; it learns from the labelled rows of the input documents.

    A null text is scored as an empty one. Repeated rows are judged each, equal texts alike. Without labels all stay or none.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.keep_quality_documents(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a quality rule rejects: a null or empty text has too few words; repeated rows are judged each."""
    return quality_rules.keep_quality(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near copies, that with the least doc_id.

    Of rows that repeat a doc_id and a text one stays; a doc_id on texts of several classes stays with each. Texts without
    words are a class for each doc_id and text, and rows with a null doc_id stay, all of them.
    """
    return jaccard_join.keep_one_per_class(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents, some in several passes, so that tokens meet the target weights; a leaf's last one up to its budget.

    Null languages and sources are nodes of their own. Rows that repeat a doc_id and a text are drawn as often as all of them.
    """
    return mixing.mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays the drawn documents out in sequences: each row whole, a null text as its end id alone; an empty table gives none."""
    return packing.pack_documents(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("jaccard_join", deduplicate),
    ("mixing", mix),
    ("packing", pack),
]

#: The classifier and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
