"""Term counts over a stream of documents: the text functions of the batch plans, with a watermark and tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import text as T


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes", stop: list[str] | None = None) -> DataFrame:
    """(window, docset, term, cnt) of a stream with columns ts (timestamp), docset and line; rows later than `late` are dropped."""
    tokens = T.drop_stop_words(T.blank_split(T.normalize(F.col("line"))), stop or [])
    rows = stream.withWatermark("ts", late).select("ts", "docset", F.explode(tokens).alias("term"))
    return rows.groupBy(F.window("ts", window).alias("window"), "docset", "term").agg(F.count(F.lit(1)).alias("cnt"))
