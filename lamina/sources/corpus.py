"""Readers of text corpora: a folder with documents `<set>.<n>`, one sentence to a line, and gold standards `<set>.label`."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import text as T
from lamina.functions.stemmer import with_stems
from lamina.session import materialize, setting


#: What opening a file counts as in bytes where Spark deals small files to tasks: documents are a few KB, so a task gets some 2,000.
OPEN_COST = 64 << 10
#: Names of documents and gold standards.
NAMES = "*.{[0-9]*,label}"


def read_files(spark: SparkSession, folder: str, glob: str = NAMES) -> DataFrame:
    """(name, value) of the files in `folder`, as a scratch table: the folder is listed once and each file opened once."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    rows = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("content").cast("string").alias("value"))
    with setting(spark, "spark.sql.files.openCostInBytes", str(OPEN_COST)):
        return materialize(rows, "files")


def documents_of(files: DataFrame) -> DataFrame:
    """(docset, doc_id, value) of the documents among `files` (name, value) whose set has a document 0; ids may have gaps."""
    name = F.col("name")
    docs = files.select(F.regexp_extract(name, r"^(.*)\.\d+$", 1).alias("docset"), F.regexp_extract(name, r"\.(\d+)$", 1).alias("n"), "value").where("n <> ''")
    docs = docs.withColumn("doc_id", F.col("n").cast("int"))
    docs = docs.join(docs.where("doc_id = 0").select("docset").distinct(), "docset", "left_semi")
    return docs.select("docset", "doc_id", F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"\n\z", "").alias("value"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(docset, doc_id, pos, line) of every document in `folder` whose set has a document 0; ids may have gaps."""

    def named(glob: str) -> DataFrame:
        files = spark.read.text(folder, wholetext=True, pathGlobFilter=glob).withColumn("file", F.input_file_name())
        name = F.regexp_extract(F.url_decode(F.regexp_replace("file", r"\+", "%2B")), r"([^/]+)$", 1)
        docs = files.select(F.regexp_extract(name, r"^(.*)\.\d+$", 1).alias("docset"), F.regexp_extract(name, r"\.(\d+)$", 1).alias("n"), "value").where("n <> ''")
        return docs.withColumn("doc_id", F.col("n").cast("int"))

    docs = named("*.[0-9]*")
    sets = named("*.0*").where("doc_id = 0").select("docset").distinct()  # of the files, only those that can be documents 0
    docs = docs.join(sets, "docset", "left_semi").withColumn("value", F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"\n\z", ""))
    return docs.select("docset", "doc_id", F.posexplode(F.split("value", "\n")).alias("pos", "line"))


def labels_of(files: DataFrame) -> DataFrame:
    """(docset, label, doc_id, start, end), both ends included, from lines `label doc::start-end ...` of the gold standards among `files` (name, value)."""
    lines = files.where("name LIKE '%.label'").select(F.regexp_extract("name", r"^(.+)\.label$", 1).alias("docset"), F.explode(F.split("value", "\r\n|\n|\r")).alias("line"))
    parts = F.filter(F.split(F.trim("line"), " +"), lambda p: p != "")
    rows = lines.select("docset", parts.alias("p")).where("size(p) > 0")
    spans = rows.select("docset", F.col("p")[0].alias("label"), F.explode(F.slice("p", 2, F.size("p"))).alias("span"))
    at = lambda i: F.regexp_extract("span", r"^(\d+)::(\d+)-(\d+)$", i).cast("int")
    return spans.where(F.col("span").rlike(r"^\d+::\d+-\d+$")).select("docset", "label", at(1).alias("doc_id"), at(2).alias("start"), at(3).alias("end"))


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """`labels_of` the files in `folder`."""
    return labels_of(read_files(spark, folder, "*.label"))


def read_stop_words(spark: SparkSession, path: str, stemmed: bool = False, skip_first: bool = True) -> DataFrame:
    """(term): the words of a list, trimmed and in lower case, without its first line as is the custom for these lists."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    words = rows.where("n > 0" if skip_first else "true").select(F.lower(F.trim("line")).alias("term")).where("term <> ''").distinct()
    if stemmed:
        words = with_stems(words).select(F.col("stem").alias("term")).distinct()
    return words


def parse_config(lines: Iterable[str]) -> dict[str, str]:
    """Keys and values, parted by blanks, tabs or `=`; the first of equal keys counts, lines without a value don't."""
    out: dict[str, str] = {}
    for line in lines:
        fields = [f for f in re.split(r"[\t =]+", line.strip()) if f]
        if len(fields) >= 2:
            out.setdefault(fields[0], fields[1])
    return out


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    return parse_config(spark.read.text(path, wholetext=True).first()[0].splitlines())


def with_prefix(config: dict[str, str], prefix: str) -> dict[str, str]:
    return {k: v for k, v in config.items() if k.startswith(prefix)}


def check_spans(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """`labels` with `inside`: whether the span lies within the text that is there (some gold standards point beyond)."""
    sizes = lines.groupBy("docset", "doc_id").agg((F.max("pos") + 1).alias("n"))
    return labels.join(sizes, ["docset", "doc_id"], "left").withColumn("inside", F.coalesce(F.col("end") < F.col("n"), F.lit(False))).drop("n")


def gold_labels(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """(docset, doc_id, pos, label): gold clusters numbered from 0 by label within the docset; each stretch of sentences without
    one gets a negative label of its own."""
    rank = F.dense_rank().over(Window.partitionBy("docset").orderBy("label")) - 1
    spans = labels.withColumn("cluster", rank)
    at = lines.select("docset", "doc_id", "pos").join(spans, ["docset", "doc_id"], "left")
    inside = F.when((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end")), F.col("cluster"))
    marked = at.groupBy("docset", "doc_id", "pos").agg(F.max(inside).alias("cluster"))
    order = Window.partitionBy("docset", "doc_id").orderBy("pos")
    begins = (F.col("cluster").isNull() & (F.lag("cluster").over(order).isNotNull() | (F.col("pos") == 0))).cast("int")
    stretch = F.sum(begins).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return marked.select("docset", "doc_id", "pos", F.coalesce("cluster", -stretch).cast("int").alias("label"))


def labelled_lines(docs: DataFrame, labels: DataFrame, stop: Iterable[str]) -> DataFrame:
    """(docset, doc_id, pos, line, label, kept) of `documents_of`: lines with their `gold_labels` and how many of their normalised tokens are
    outside a stop list. Documents meet their spans as wholes, so lines aren't joined with anything."""
    rank = F.dense_rank().over(Window.partitionBy("docset").orderBy("label")) - 1
    spans = labels.select("docset", "doc_id", F.struct(rank.alias("cluster"), "start", "end").alias("span"))
    spans = spans.groupBy("docset", "doc_id").agg(F.collect_list("span").alias("spans"))
    without = frozenset([*stop, ""])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for docset, doc_id, value, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = value.split("\n")
                kept = [sum([t not in without for t in line.split(" ")]) for line in T.normalized(value + "\n")]
                more = (repeat(docset, len(lines)), repeat(doc_id, len(lines)), range(len(lines)), lines, _gold(len(lines), own or []), kept)
                for values, x in zip(out, more, strict=True):
                    values.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names)

    names, kinds = ["docset", "doc_id", "pos", "line", "label", "kept"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64()]
    rows = docs.join(spans, ["docset", "doc_id"], "left").select("docset", "doc_id", "value", "spans")
    return rows.mapInArrow(run, "docset string, doc_id int, pos int, line string, label int, kept long")


def _gold(n: int, spans: list[dict]) -> list[int]:
    """`gold_labels` of a document of n lines."""
    of, stretch = [-1] * n, 0
    for x in spans:
        for pos in range(x["start"], min(x["end"] + 1, n)):
            of[pos] = max(of[pos], x["cluster"])
    out: list[int] = []
    for pos, cluster in enumerate(of):
        stretch += cluster < 0 and (pos == 0 or of[pos - 1] >= 0)
        out.append(cluster if cluster >= 0 else -stretch)
    return out
