"""Topics as tables: word counts, sentences (`n_dish`), documents (`n_restaurant`) and distinctive words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topic_vectors(bow: DataFrame, labels: DataFrame) -> DataFrame:
    """(docset, topic, term, cnt) of global topics: `labels` (docset, doc_id, pos, label) with label >= 0."""
    return labelled_vectors(bow.join(labels, ["docset", "doc_id", "pos"]))


def labelled_vectors(bow: DataFrame) -> DataFrame:
    """`topic_vectors` of a `bow` that has the column `label`."""
    return bow.where("label >= 0").withColumnRenamed("label", "topic").groupBy("docset", "topic", "term").agg(F.sum("cnt").alias("cnt"))


def topic_sizes(labels: DataFrame) -> DataFrame:
    """(docset, topic, n_dish, n_restaurant): sentences and documents of each global topic."""
    own = labels.where("label >= 0").withColumnRenamed("label", "topic")
    return own.groupBy("docset", "topic").agg(F.count(F.lit(1)).alias("n_dish"), F.count_distinct("doc_id").alias("n_restaurant"))


def distinctive_words(vectors: DataFrame, n: int = 40, smoothing: float = 0.1) -> DataFrame:
    """(docset, topic, rank, term, score): the `n` words with the highest p (ln p - mean over topics of ln p).

    p = (c + smoothing) / (sum + smoothing * nonzero). A word that a topic lacks has the topic's floor there, so the mean over
    topics is the mean of all floors plus what the topics that have the word differ by: no table of terms times topics.
    """
    live, topic = vectors.where("cnt > 0"), Window.partitionBy("docset", "topic")
    size = live.groupBy("docset", "topic").agg((F.sum("cnt") + smoothing * F.count(F.lit(1))).alias("size"))
    floors = size.groupBy("docset").agg(F.avg(F.log(smoothing / F.col("size"))).alias("floor"), F.count(F.lit(1)).alias("topics"))
    p = (F.col("cnt") + smoothing) / F.col("size")
    rows = live.withColumn("size", F.sum("cnt").over(topic) + smoothing * F.count(F.lit(1)).over(topic))
    rows = rows.withColumn("p", p).withColumn("over", F.log("p") - F.log(smoothing / F.col("size"))).join(floors, "docset")
    mean = F.col("floor") + F.sum("over").over(Window.partitionBy("docset", "term")) / F.col("topics")
    scored = rows.withColumn("mean", mean).withColumn("score", F.col("p") * (F.log("p") - F.col("mean")))
    rank = F.row_number().over(topic.orderBy(F.desc(F.round("score", 9)), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= n).select("docset", "topic", "rank", "term", "score")
