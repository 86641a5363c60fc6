"""From raw documents to training sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, jaccard_join, pieces, quality, toxicity
from quire.llm.common import dropped, numbered, shared_path, stored


def _where(scored: DataFrame, keep: Callable[[Column], Column], columns: list[str]) -> DataFrame:
    """Rows whose last column, the score, is to be kept, without it; columns are told by their places, whatever they are called."""
    names = [f"c{i}" for i in range(len(scored.columns))]
    return scored.toDF(*names).where(keep(F.col(names[-1]))).select(*names[:-1]).toDF(*columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic (score 0.5 or more) go.

    Each row is judged by its own text, so null and repeated ids make no difference; null and empty texts stay; no labels or no documents: all
    (none) stay; all columns are kept, whatever they are called.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _where(toxicity.score(docs, model), lambda score: score < 0.5, docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go.

    Each row is judged by its own text, so null and repeated ids make no difference; null and empty texts stay; an empty table stays empty; all
    columns are kept, whatever they are called.
    """
    return _where(quality.score(docs, quality.fit(docs)), lambda score: score >= quality.KEEP, docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (by links at 0.8), the document with the smallest doc_id stays.

    Rows are told apart by their places: of rows that repeat a doc_id, or have none, one stays for each group; a null doc_id comes after all
    others. Texts without words (null, empty) are no duplicates of each other; an empty table stays empty; all columns are kept.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = numbered(docs, "quire_row").toDF(*names, "quire_row")
    text, doc_id = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    linked = jaccard_join.jaccard_links(rows, key="quire_row", text=text).where("n_links > 0").select(F.col("doc_id").alias("quire_row"), "class_id")
    members = stored(linked.join(rows.select("quire_row", F.col(doc_id).alias("doc_id")), "quire_row"), "near-copies")
    # the least of each group is found before rows are shuffled
    first = members.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "quire_row"))["quire_row"].alias("first"))
    gone = stored(members.join(first, "class_id").where("quire_row != first").select("quire_row"), "near-copies")
    return rows.join(gone, "quire_row", "left_anti").select(*names).toDF(*docs.columns)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Each row is judged by its own text, so null and repeated ids make no difference; texts without words stay; without items all stay; an empty table
    stays empty; all columns are kept.
    """
    folder = shared_path(spark, "benchmark")
    blocks = decontamination.index_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), docs, folder)
    return decontamination.clean(docs, folder, blocks)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with merge-dropout, and whether they decode to it.

    Null and empty texts have no ids; rows that repeat a doc_id and a text get the same ids, a null doc_id counts as 0; an empty table stays empty; other columns are
    kept, and a column of the result that is called like one of them gets ``quire_`` in front.
    """
    return pieces.encode(docs)


STAGES = [
    ("toxicity", toxic),
    ("quality", good),
    ("near-duplicates", distinct),
    ("decontamination", clean),
    ("pieces", encoded),
]

#: Training and MinHash have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, before = stored(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        dropped(before)  # files of this run only: the table of documents isn't one of them
    return docs
