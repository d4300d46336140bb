"""Session helpers shared by every plan: table access, code shipping and shared scratch space."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

#: Bounds what a Python worker holds of a table of long texts.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the jobs made inside."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`; the path may use any scheme that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so Python workers can import it, and set `ARROW` on the session.

    Goes through Spark's own file server; nothing is read from a folder that executors would have to share.
    """
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="lamina"), "lamina_ship.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(root):
                for n in sorted(names):
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(target)
        _SHIPPED.add(app)
    for key, value in ARROW.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, else a folder made for a local session.

    A machine-local folder is used only where the setting is unset and the master is local, as in tests; on a cluster without the
    setting this raises.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="lamina-shared")
        sc.setCheckpointDir(d)
    return d.rstrip("/")


@dataclass(frozen=True)
class _Table:
    """A table of the catalog over scratch folders."""

    name: str


#: Of no scope: what `clean` deletes.
_LOOSE: list[str | _Table] = []
#: The scopes that are open where the code runs, innermost last; threads and tasks that run at once have scopes of their own.
_OPEN: contextvars.ContextVar[tuple[list[str | _Table], ...]] = contextvars.ContextVar("lamina-scopes", default=())


def _owner(outer: int) -> list[str | _Table]:
    scopes = (_LOOSE, *_OPEN.get())
    return scopes[max(0, len(scopes) - 1 - outer)]


def scratch(spark: SparkSession, name: str, outer: int = 0) -> str:
    """A fresh path below the shared folder. It belongs to the innermost scope, or to the one `outer` scopes further out."""
    path = f"{shared_dir(spark)}/lamina/{name}-{uuid.uuid4().hex[:12]}"
    _owner(outer).append(path)
    return path


def drop_later(*tables: str, outer: int = 0) -> None:
    """Tables of the catalog that go, without what they are over, where a path of `scratch` would be deleted."""
    _owner(outer).extend(map(_Table, tables))


def _delete(spark: SparkSession, held: list[str | _Table]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for x in sorted(held, key=lambda x: isinstance(x, str)):  # tables first
        if isinstance(x, _Table):
            spark.sql(f"DROP TABLE IF EXISTS {x.name}")
        else:
            p = jvm.org.apache.hadoop.fs.Path(x)
            p.getFileSystem(conf).delete(p, True)


@contextlib.contextmanager
def scope(spark: SparkSession, collect: bool = True) -> Iterator[None]:
    """Scratch folders made inside are deleted at the end, but for those made with `outer=1`, which belong to the scope around.

    What a caller returns must not read the deleted ones: write it with `materialize(..., outer=1)`. With `collect` the driver then collects
    its garbage, which lets Spark's cleaner free broadcasts and shuffles of frames that are gone.
    """
    own: list[str | _Table] = []
    token = _OPEN.set((*_OPEN.get(), own))
    try:
        yield
    finally:
        _OPEN.reset(token)
        _delete(spark, own)
        if collect:
            gc.collect()
            spark._jvm.System.gc()


def clean(spark: SparkSession) -> None:
    """Delete the scratch folders of no scope: call it when the frames that queries returned are no longer needed."""
    held = _LOOSE.copy()
    _LOOSE.clear()
    _delete(spark, held)


def materialize(df: DataFrame, name: str, outer: int = 0, codec: str | None = None) -> DataFrame:
    """Write `df` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    return _written(df, scratch(df.sparkSession, name, outer), codec)


#: Bytes of a row group of scratch tables: what a task's writer holds in the heap.
ROW_GROUP = 16 << 20


def _written(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, name: str, outer: int = 0, most: int = 16 << 20) -> DataFrame:
    """`df` as `materialize` gives it, with a broadcast hint if its files hold at most `most` bytes, else with a hint to merge."""
    spark = df.sparkSession
    path = scratch(spark, name, outer)
    out = _written(df, path)
    return out.hint("broadcast" if length(spark, path) <= most else "merge")


def length(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files below a folder, in any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def bucketed(df: DataFrame, name: str, parts: int, key: str, outer: int = 0) -> DataFrame:
    """`df`, which is dealt by `key` to `parts` tasks, written as a table of as many buckets and read back: aggregates, windows and joins by
    `key` take no exchange there."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name, outer)
    of = f"lamina_{path.rsplit('/', 1)[1].replace('-', '_')}"
    drop_later(of, outer=outer)
    df.write.option("parquet.block.size", ROW_GROUP).bucketBy(parts, key).saveAsTable(of, format="parquet", path=path)
    return spark.table(of)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` dealt by `keys` to several tasks for each core: groups that are small in bytes but long in work must not be coalesced."""
    spark = df.sparkSession
    return df.repartition(max(partitions(spark), 4 * spark.sparkContext.defaultParallelism), *keys)
