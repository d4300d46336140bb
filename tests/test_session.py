"""Scopes of scratch folders: by thread, nested, and with tables of the catalog."""

import os
import threading

from lamina import session


def test_scopes_of_threads_are_apart(spark):
    """Two threads whose scopes overlap in time: each deletes what it made itself."""
    entered, made, ended, seen = threading.Event(), threading.Event(), threading.Event(), {}

    def first():
        with session.scope(spark, collect=False):
            entered.wait(30)
            path = session.scratch(spark, "a")
            os.makedirs(path)
            made.set()
            ended.wait(30)
            seen["inside"] = os.path.isdir(path)
        seen["after"] = os.path.isdir(path)

    def second():
        with session.scope(spark, collect=False):
            entered.set()
            made.wait(30)
        ended.set()

    threads = [threading.Thread(target=f) for f in (first, second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert seen == {"inside": True, "after": False}


def test_nested_scopes_and_clean(spark):
    loose = session.scratch(spark, "loose")
    os.makedirs(loose)
    with session.scope(spark, collect=False):
        with session.scope(spark, collect=False):
            inner, outer, beyond = (session.scratch(spark, n, outer=k) for k, n in enumerate("abc"))
            for p in (inner, outer, beyond):
                os.makedirs(p)
        assert [os.path.isdir(p) for p in (inner, outer, beyond)] == [False, True, True]
    assert [os.path.isdir(p) for p in (outer, beyond, loose)] == [False, True, True]
    session.clean(spark)
    assert not os.path.isdir(beyond) and not os.path.isdir(loose)


def test_catalog_tables_go_with_their_scope(spark):
    with session.scope(spark, collect=False):
        path = session.scratch(spark, "table")
        spark.range(3).write.parquet(path)
        spark.sql(f"CREATE TABLE scope_test USING parquet LOCATION '{path}'")
        session.drop_later("scope_test")
        assert spark.table("scope_test").count() == 3
    assert not spark.catalog.tableExists("scope_test") and not os.path.isdir(path)
