"""A training-data pipeline of five stages, each one of the operators in ``corpusmill.llm`` put to work.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the documents that go on, with the
columns of ``documents``; the last adds ``copy``, the number of the copy that the mix takes. ``run`` writes each stage as
Parquet in the shared folder and reads it back as the next one's input.

Decisions are made by row: the operators get a hash of id and text in place of the id, so that rows without an id are
judged like any other, and rows that share an id each by their own text. In all stages a null text counts as an empty one,
texts are read whole, an empty table gives an empty one, and further columns of the input, whatever their names, go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import common, decontaminate, ftrl, jaccard_join, line_templates, mixing, quality


def _node(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"])


def _by_row(docs: DataFrame) -> DataFrame:
    """What the operators get: (doc_id, text) with a hash of both in place of the id."""
    return docs.select(_node(docs).alias("doc_id"), docs["text"])


def _kept(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose hash is among the values of ``chosen``, a table of one column."""
    chosen = chosen.toDF("chosen_node").distinct()
    return docs.join(chosen, _node(docs) == chosen["chosen_node"], "left_semi")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good; it learns by the ids that labels has, and judges by text."""
    model = quality.learn_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _kept(docs, ftrl.scored(_by_row(docs), model, quality.features).filter("score >= 0.5").select("doc_id"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines whose template recurs. Rows that repeat lose the same lines."""
    return line_templates.drop_lines(docs).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the smallest id, null last, of equal ids the smallest hash.

    Of rows with the same id and text one stays, the smallest by all its columns. Texts without words are no duplicates.
    """
    nodes = docs.select(_node(docs).alias("node"), docs["doc_id"].cast("long").alias("id"))
    found = jaccard_join.join_components(_by_row(docs)).select(F.col("doc_id").alias("node"), F.col("component_id").alias("group")).distinct()
    first = nodes.distinct().join(found, "node").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
    rows = _kept(docs, first.select("first.node"))
    again = common.durable(nodes.groupBy("node").count().filter("count > 1").select("node"))
    if again.isEmpty():
        return rows
    once = again.select(F.col("node").alias("chosen_node"))
    single = rows.join(once, _node(rows) == once["chosen_node"], "left_anti")
    several = _kept(rows, again).groupBy(F.struct("doc_id", "text")).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("least"))
    return single.unionByName(several.select(*[F.col("least").getField(c).alias(c) for c in docs.columns]))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    found = decontaminate.find_contamination(_by_row(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _kept(docs, found.filter("size(spans) = 0").select("doc_id"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source."""
    return mixing.emitted(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The first stage is a trained classifier, which SQL can't express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = common.durable(stage(spark, docs, sf_dir))
        if last is not None:
            common.release(last)
        last = docs
    return docs
