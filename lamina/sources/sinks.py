"""Exports: segmented text, topic words, reports."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DOC = ["docset", "doc_id"]


def segmented_lines(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(docset, doc_id, out_pos, out): the raw lines with a rule before each segment, `=====[ label]`, the label for global topics
    only, and a rule at the end. Blank lines are dropped; in lines that begin with a rule it becomes `-----`, and they take none.

    `labels` (docset, doc_id, pos, label) joins by position, so a line without a label is kept as it stands.
    """
    order = Window.partitionBy(*DOC).orderBy("pos")
    rows = lines.where(F.trim("line") != "").join(labels, [*DOC, "pos"], "left")
    ruled = F.col("line").startswith("=====")
    before = F.last(F.when(~ruled, F.struct(F.col("label"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = ~ruled & F.col("label").isNotNull() & (before.isNull() | ~before["label"].eqNullSafe(F.col("label")))
    rule = F.when(begins, F.concat(F.lit("====="), F.when(F.col("label") >= 0, F.concat(F.lit(" "), F.col("label").cast("string"))).otherwise(F.lit(""))))
    shown = F.when(ruled, F.replace(F.col("line"), F.lit("====="), F.lit("-----"))).otherwise(F.col("line"))
    last = F.when(F.lead("pos").over(order).isNull(), F.lit("====="))
    rows = rows.withColumn("rule", rule).withColumn("last", last)
    out = rows.select(*DOC, "pos", F.posexplode(F.filter(F.array("rule", shown, "last"), lambda x: x.isNotNull())).alias("part", "out"))
    return out.select(*DOC, (F.row_number().over(Window.partitionBy(*DOC).orderBy("pos", "part")) - 1).alias("out_pos"), "out")


def write_files(files: DataFrame, folder: str) -> int:
    """Write `files` (name, value), one text each, into `folder`: a path or a URI that pyarrow knows, reached by all executors. Returns
    how many. A file is written under another name and then given its own, so one that is there is whole; a task that runs again writes the
    same files again."""
    where = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(where)
        store.create_dir(root, recursive=True)
        for pdf in batches:
            for name, value in zip(pdf["name"], pdf["value"], strict=True):
                part = f"{root}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(value.encode("utf-8"))
                store.move(part, f"{root}/{name}")
            yield pdf[["name"]]

    return files.select("name", "value").mapInPandas(write, "name string").agg(F.count("name")).first()[0]


def document_files(lines: DataFrame) -> DataFrame:
    """(name, value): the files `<docset>.<doc_id>` of documents, a line end after each line. Signs that a file name can't hold are
    percent-encoded in the docset."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "line")))
    docs = lines.groupBy(*DOC).agg(rows.alias("rows"))
    text = F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n"))
    return docs.select(F.concat(F.url_encode("docset"), F.lit("."), F.col("doc_id").cast("string")).alias("name"), text.alias("value"))


def text_files(documents: DataFrame) -> DataFrame:
    """`document_files` of the lines of `documents` (docset, doc_id, text), made of whole texts: lines aren't parted and put together again,
    but where several texts share an id, whose lines go by place. Null texts have no file."""
    lines = lambda text: F.transform(F.split(F.regexp_replace(text, r"\n\z", ""), "\n"), lambda line, pos: F.struct(pos.alias("pos"), line.alias("line")))
    docs = documents.where("text IS NOT NULL").groupBy(*DOC).agg(F.collect_list("text").alias("texts"))
    shared = F.array_join(F.transform(F.array_sort(F.flatten(F.transform("texts", lines))), lambda r: r["line"]), "\n")
    text = F.when(F.size("texts") == 1, F.regexp_replace(F.col("texts")[0], r"\n\z", "")).otherwise(shared)
    return docs.select(F.concat(F.url_encode("docset"), F.lit("."), F.col("doc_id").cast("string")).alias("name"), F.concat(text, F.lit("\n")).alias("value"))


def label_files(spans: DataFrame) -> DataFrame:
    """(name, value): the files `<docset>.label` of clusters (docset, label, doc_id, start, end), both ends included: a cluster in a line."""
    span = F.format_string("%d::%d-%d", "doc_id", "start", "end")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "start", span.alias("span")))), lambda r: r["span"])
    rows = spans.groupBy("docset", "label").agg(F.array_join(ordered, " ").alias("spans"))
    listing = F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", F.col("label"), F.col("spans")))), "\n")
    return rows.groupBy("docset").agg(listing.alias("value")).select(F.concat(F.url_encode("docset"), F.lit(".label")).alias("name"), "value")


def write_segmented(lines: DataFrame, labels: DataFrame, folder: str) -> None:
    """One text per document, in folders docset=/doc_id=."""
    out = segmented_lines(lines, labels).groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("out_pos", "out"))).alias("rows"))
    out.select(*DOC, F.array_join(F.transform("rows", lambda r: r["out"]), "\n").alias("value")).write.partitionBy(*DOC).text(folder)


def topic_word_lines(words: DataFrame) -> DataFrame:
    """(docset, topic, value): a listing of each topic's words from (docset, topic, rank, term, score)."""
    row = F.concat_ws(" ", F.col("term"), F.col("score").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("rank"), row.alias("row"))))
    listing = words.groupBy("docset", "topic").agg(rows.alias("r"))
    head = F.concat(F.lit("TOPIC "), F.col("topic").cast("string"), F.lit("\n"))
    return listing.select("docset", "topic", F.concat(head, F.array_join(F.transform("r", lambda x: x["row"]), "\n"), F.lit("\n")).alias("value"))


def write_lines(frame: DataFrame, path: str, column: str = "value") -> None:
    frame.select(F.col(column).alias("value")).write.text(path)
