"""Exact deduplication against a persistent digest index.

The index is two Parquet tables, bucketed and sorted by digest, beside a table of its format: `entries` (digest, keep_id, group_size,
batch), one row for each digest as its first batch had it, and `sightings` (digest, n, batch), how many rows of later batches had it. A batch is first reduced to one row for each
digest (partial aggregation, so a text that makes up a third of the rows costs one row for each map task), then anti-joined with the
entries by sort-merge on the bucketed key (no exchange on the index side), and what is new is appended. Everything here is DataFrame
operations.

The index is a folder. Any session that opens it takes the number of buckets from the folder, not from itself; catalog names come from
the whole path. A batch that was cut off may be ingested again under its number: what is there already isn't added twice.

Defined edge cases: a null text is the empty text; texts are equal when they are identical byte for byte; rows with a
null `doc_id` count in `group_size` and are kept only when their whole group has no id; a repeated row (same id, same
text) gets the same verdict as its twin; an empty table gives an empty result; other columns pass through `annotate` untouched, and where
they have names that it adds, the caller chooses another one for what it adds.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.session import drop_later, materialize, partitions, scratch

FORMAT = 1
#: A digest that holds at least this share of the rows is joined by broadcast: at most 1 / share such digests exist.
HEAVY_SHARE = 1 / 1000


def digest_of(text) -> F.Column:
    """SHA-256 of the UTF-8 text, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class DigestIndex:
    """A persistent index of digests in a folder."""

    COLUMNS = {"entries": "digest BINARY, keep_id BIGINT, group_size BIGINT, batch BIGINT", "sightings": "digest BINARY, n BIGINT, batch BIGINT"}

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """Open the index at `path` (a shared folder), creating it if there is none.

        The number of buckets is fixed at creation, by `buckets` or else the session's number of shuffle partitions. Later it comes
        from the folder; a `buckets` that differs from it is an error.
        """
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.spark, self.path = spark, p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()
        try:
            found = spark.read.schema("format int, buckets int").parquet(f"{self.path}/format").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            found = None
        if found is None:
            found = {"format": FORMAT, "buckets": buckets or partitions(spark)}
            spark.range(1).select(*(F.lit(v).alias(k) for k, v in found.items())).coalesce(1).write.parquet(f"{self.path}/format")
        if found["format"] != FORMAT or buckets not in (None, found["buckets"]):
            raise ValueError(f"the index at {self.path} has format {found['format']} and {found['buckets']} buckets")
        self.buckets = found["buckets"]
        key = hashlib.sha256(self.path.encode("utf-8")).hexdigest()[:40]
        self.names = {kind: f"digest_{kind}_{key}" for kind in self.COLUMNS}
        for kind, columns in self.COLUMNS.items():
            location = f"{self.path}/{kind}".replace("'", "\\'")
            spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.names[kind]} ({columns}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                f"INTO {self.buckets} BUCKETS LOCATION '{location}'"
            )
            # A catalog may outlive sessions, and the folder may have been made anew meanwhile.
            known = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {self.names[kind]}").collect()}
            if int(known["Num Buckets"]) != self.buckets:
                raise ValueError(f"table {self.names[kind]} has {known['Num Buckets']} buckets, the folder {self.buckets}; drop the table")
            spark.catalog.refreshTable(self.names[kind])

    def table(self, kind: str = "entries") -> DataFrame:
        return self.spark.table(self.names[kind])

    def ingest(self, batch: DataFrame, batch_no: int | None = None) -> None:
        """Append the digests of `batch` (doc_id, digest) that the index lacks. Within the batch the largest id wins; between
        batches the one that was ingested earlier. `batch_no` is the next one by default."""
        if batch_no is None:
            last = self.table().select("batch").union(self.table("sightings").select("batch")).agg(F.max("batch"))
            batch_no = (last.first()[0] or 0) + 1
        groups = batch.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        # Written first: the optimizer would move the anti-join below the aggregation, where a hot digest is many rows.
        groups = materialize(groups, "batch-digests").withColumn("batch", F.lit(batch_no).cast("long"))
        earlier = self.table().where(F.col("batch") != batch_no).select("digest")
        again = groups.hint("merge").join(earlier.hint("merge"), "digest", "left_semi").select("digest", "n", "batch")
        self._append("sightings", again, self.table("sightings").where(F.col("batch") == batch_no))
        self._append("entries", groups.select("digest", "keep_id", F.col("n").alias("group_size"), "batch"), self.table())

    def _append(self, kind: str, rows: DataFrame, there: DataFrame) -> None:
        fresh = rows.hint("merge").join(there.select("digest").hint("merge"), "digest", "left_anti")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.names[kind])
        self.spark.catalog.refreshTable(self.names[kind])

    def groups(self) -> DataFrame:
        """(digest, keep_id, group_size) of all digests; both tables are read bucket by bucket, without an exchange."""
        later = self.table("sightings").groupBy("digest").agg(F.sum("n").alias("__later"))
        both = self.table().hint("merge").join(later.hint("merge"), "digest", "left")
        return both.select("digest", "keep_id", (F.col("group_size") + F.coalesce("__later", F.lit(0))).alias("group_size"))

    def annotate(self, batch: DataFrame, into: str | None = None) -> DataFrame:
        """`batch` (with doc_id, digest) plus keep_id, group_size and kept, as the index has them, or a struct `into` of the three.

        Digests with a large share of the rows are few by counting (at most 1 / HEAVY_SHARE), so they are broadcast;
        all others meet the index in a sort-merge join that no single key can overload.
        """
        clash = {into} if into else {"keep_id", "group_size", "kept"}
        if clash & set(batch.columns):
            raise ValueError(f"the batch already has {sorted(clash & set(batch.columns))}; choose another name for `into`")
        found = into or "__found"
        rows = self.groups().select("digest", F.struct("keep_id", "group_size").alias(found))
        parts = self.table().select("group_size").union(self.table("sightings").select("n"))
        total = parts.agg(F.sum("group_size")).first()[0] or 0
        heavy_from = max(2, int(total * HEAVY_SHARE) + 1)
        here, size = F.col(f"`{found}`"), F.col(f"`{found}`.group_size")
        heavy = materialize(rows.where(size >= heavy_from), "heavy-digests", outer=1)
        marked = batch.join(F.broadcast(heavy), "digest", "left")
        merged = marked.where(here.isNull()).drop(found).hint("merge").join(rows.where(size < heavy_from).hint("merge"), "digest", "left")
        out = marked.where(here.isNotNull()).unionByName(merged)
        out = out.withColumn(found, here.withField("kept", F.col("doc_id").eqNullSafe(F.col(f"`{found}`.keep_id"))))
        return out if into else out.select(*batch.columns, f"{found}.*")


def exact_dedup(docs: DataFrame, path: str | None = None, batches: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Load `docs` (doc_id, text) into the index at `path` (default: a new one) and annotate every row.

    Rows go in by falling doc_id, in `batches` batches of about as many rows each, those without an id last: as the earlier batch
    wins, the largest id of equal texts stays. Returns doc_id, keep_id, group_size, kept, text_sha256 and the columns `keep`; one row
    for each row of `docs`.
    """
    spark = docs.sparkSession
    digests = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), *keep)
    digests = materialize(digests, "digests", outer=1)
    index = DigestIndex(spark, path or scratch(spark, "digest-index", outer=1))
    if path is None:
        drop_later(*index.names.values(), outer=1)
    cuts = [k / batches for k in range(batches - 1, 0, -1)]
    edges = sorted(set(digests.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts))) if cuts else F.lit(None)).first()[0] or []), reverse=True)
    upper = None
    for edge in [*edges, None]:
        part = F.lit(True) if edge is None else F.col("doc_id") >= edge
        if upper is not None:
            part &= (F.col("doc_id") < upper) | F.col("doc_id").isNull() if edge is None else F.col("doc_id") < upper
        index.ingest(digests.where(part))
        upper = edge
    found = index.annotate(digests, "__found")
    return found.select("doc_id", "__found.keep_id", "__found.group_size", "__found.kept", F.lower(F.hex("digest")).alias("text_sha256"), *keep)
