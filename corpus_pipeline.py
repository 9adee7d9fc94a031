"""A corpus pipeline: quality, line dedup, near-duplicates, mixture, packing; each stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import cut, table
from panelspark.llm.jaccard import jaccard_components
from panelspark.llm.line_dedup import drop_recurring_lines
from panelspark.llm.mixing import mix_sources
from panelspark.llm.packing import pack
from panelspark.llm.quality import quality_scores

#: No stage but the line templates could be put in SQL: the classifier is trained and the packing solved by iteration.
ORACLE_SQL: str | None = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Rows with one doc_id go together, as soon as one of them is rejected; rows of a null doc_id stay. A null or empty text is scored like
    any other. Without a label of good text there is no classifier, and all rows stay.
    """
    labels = table(spark, sf_dir, "labels")
    if labels.where("quality = 1").isEmpty():
        return docs
    scores = quality_scores(docs, labels).where("predicted = 0").select("doc_id").distinct()
    return docs.join(scores, "doc_id", "left_anti")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one that consisted of nothing else goes. Its lines stay in their first document.

    A null, empty or blank text has no lines and stays; repeated rows are treated alike. Where there is a column n_chars, it
    follows the text that is left.
    """
    cleaned = drop_recurring_lines(docs).where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long"))
    return cleaned.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates (five words, similarity 0.8).

    Texts without words are duplicates of nothing and stay. Rows equal in doc_id stay or go together; rows of a null doc_id have no
    name to be dropped by, and stay.
    """
    others = jaccard_components(docs, width=5, percent=80).where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes it, also those of a null doc_id; rows of one doc_id have counts of their own.

    Texts without words cost nothing and are taken once. A null source is a source.
    """
    taken = mix_sources(docs, keep=True).where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select("_row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the documents left; a null or empty text is one piece, and every repeated row is packed."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", one_of_each),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
