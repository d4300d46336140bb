import hashlib
import os
import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lamina.llm import digest_index


def got(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()), key=str)


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        out.append((i, keep, len(groups[t or ""]), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(docs):
    rows = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, " "), (7, "é" * 5000), (8, "é" * 5000), (9, "b"), (9, "b"), (None, "a"), (None, "only null id")]
    rows += [(100 + i, "hot") for i in range(60)]
    assert got(digest_index.exact_dedup(docs(rows))) == brute(rows)


def test_empty(docs):
    assert got(digest_index.exact_dedup(docs([]))) == []


def test_index_persists_and_appends(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "index")
    first = docs([(1, "a"), (2, "b"), (3, "b")])
    again = docs([(4, "b"), (5, "c"), (6, "c")])
    digests = lambda d: d.select("doc_id", digest_index.digest_of(F.col("text")).alias("digest"))
    index = digest_index.DigestIndex(spark, path, 4)
    index.ingest(digests(first), 1)
    index.ingest(digests(again), 2)
    reopened = digest_index.DigestIndex(spark, path, 4)
    table = sorted((r["keep_id"], r["group_size"], r["batch"]) for r in reopened.table().collect())
    assert table == [(1, 1, 1), (3, 2, 1), (6, 2, 2)]
    kept = {r["doc_id"]: r["kept"] for r in reopened.annotate(digests(again)).collect()}
    assert kept == {4: False, 5: False, 6: True}
    reopened.ingest(digests(again), 3)
    assert reopened.table().count() == 3


def test_anti_join_is_sort_merge_and_native(spark, docs, tmp_path):
    from pyspark.sql import functions as F

    index = digest_index.DigestIndex(spark, str(tmp_path / "index"), 4)
    batch = docs([(1, "a")]).select("doc_id", digest_index.digest_of(F.col("text")).alias("digest"))
    plan = batch.hint("merge").join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan and "Bucketed: true" in plan


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ROWS = [(1, "a"), (2, "a"), (3, "A"), (4, None), (5, ""), (6, " "), (7, "é" * 5000), (8, "é" * 5000), (9, "b"), (9, "b"), (None, "a"), (None, "only null id")]
ROWS += [(100 + i, "hot") for i in range(60)] + [(-4, "hot"), (9, "another text under the same id")]


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_matches_brute_force_in_batches(docs, batches):
    assert got(digest_index.exact_dedup(docs(ROWS), batches=batches)) == brute(ROWS)


@pytest.mark.parametrize("rows", [[], [(None, "a"), (None, "a")], [(7, "a"), (7, "a"), (7, "b")]])
def test_few_ids(docs, rows):
    assert got(digest_index.exact_dedup(docs(rows))) == brute(rows)


def digests(d):
    return d.select("doc_id", digest_index.digest_of(F.col("text")).alias("digest"))


def entries(index):
    return sorted((r["keep_id"], r["group_size"]) for r in index.groups().collect())


def test_batches_add_up(spark, docs, tmp_path):
    path = str(tmp_path / "index")
    again = docs([(4, "b"), (5, "c"), (6, "c")])
    index = digest_index.DigestIndex(spark, path, 4)
    index.ingest(digests(docs([(1, "a"), (2, "b"), (3, "b")])))
    index.ingest(digests(again))
    reopened = digest_index.DigestIndex(spark, path)
    assert entries(reopened) == [(1, 1), (3, 3), (6, 2)]
    assert sorted((r["keep_id"], r["batch"]) for r in reopened.table().collect()) == [(1, 1), (3, 1), (6, 2)]
    assert {r["doc_id"]: r["kept"] for r in reopened.annotate(digests(again)).collect()} == {4: False, 5: False, 6: True}
    reopened.ingest(digests(again), 2)  # the same batch once more, as after a failure
    assert entries(reopened) == [(1, 1), (3, 3), (6, 2)]
    reopened.ingest(digests(again))
    assert entries(reopened) == [(1, 1), (3, 4), (6, 4)]
    with pytest.raises(ValueError, match="4 buckets"):
        digest_index.DigestIndex(spark, path, 8)


def test_paths_that_look_alike_are_two_indexes(spark, docs, tmp_path):
    for name in ("a-b", "a_b", "A_b", "x" * 100 + "a", "y" * 100 + "a"):
        index = digest_index.DigestIndex(spark, str(tmp_path / name))
        assert index.table().count() == 0
        index.ingest(digests(docs([(1, name)])))
        assert digest_index.DigestIndex(spark, f"{tmp_path}//{name}/").table().count() == 1


_OTHER = """
import sys
from pyspark.sql import SparkSession, functions as F
from lamina.llm import digest_index
path, buckets, shared = sys.argv[1], sys.argv[2], sys.argv[3]
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", buckets).config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", shared).config("spark.sql.warehouse.dir", shared + "/w" + buckets).getOrCreate())
docs = spark.range(200).select(F.col("id").alias("doc_id"), digest_index.digest_of(F.concat(F.lit("text "), F.col("id") % 150)).alias("digest"))
index = digest_index.DigestIndex(spark, path)
index.ingest(docs)
print("rows", index.table().count(), index.groups().count(), index.groups().agg(F.sum("group_size")).first()[0], index.buckets)
print("kept", index.annotate(docs).where("kept").count())
"""


def test_another_process_with_other_partitions(tmp_path):
    said = []
    for buckets in ("8", "5"):
        run = subprocess.run([sys.executable, "-c", _OTHER, str(tmp_path / "index"), buckets, str(tmp_path / "shared")], cwd=ROOT, capture_output=True, text=True, check=True, timeout=300, env={**os.environ, "PYTHONPATH": ROOT})
        said.append([line for line in run.stdout.splitlines() if line.startswith(("rows", "kept"))])
    assert said == [["rows 150 150 200 8", "kept 150"], ["rows 150 150 400 8", "kept 150"]]


def test_other_columns_pass_untouched(spark, tmp_path):
    rows = spark.createDataFrame([(1, bytes(32), 5, "k", True, 2)], "doc_id long, digest binary, group_size int, keep_id string, kept boolean, n int")
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"))
    index.ingest(rows)
    r = index.annotate(rows, "seen").first().asDict(recursive=True)
    assert r.pop("digest") == bytes(32)
    assert r == {"doc_id": 1, "group_size": 5, "keep_id": "k", "kept": True, "n": 2, "seen": {"keep_id": 1, "group_size": 1, "kept": True}}
    for name in ("n", None):
        with pytest.raises(ValueError, match="already"):
            index.annotate(rows, name)


def test_no_exchange_on_the_index_side(spark, docs, tmp_path):
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"), 4)
    batch = docs([(1, "a")]).select("doc_id", digest_index.digest_of(F.col("text")).alias("digest"))
    plan = batch.hint("merge").join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Python" not in plan and "Bucketed: true" in plan
    plan = index.groups()._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("Bucketed: true") == 2
    plan = digest_index.exact_dedup(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_own_index_leaves_no_table_in_the_catalog(spark, docs):
    from lamina.session import clean

    clean(spark)
    before = {t.name for t in spark.catalog.listTables()}
    digest_index.exact_dedup(docs([(1, "a"), (2, "a")])).collect()
    clean(spark)
    assert {t.name for t in spark.catalog.listTables()} <= before
