import random

import pytest
from pyspark.sql import functions as F

from lamina.llm import revisit

SCHEMA = "record_id long, uri string, ts long, is_full boolean, etag string, last_modified string, digest string, headers map<string,string>, url_key string, base string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("http://WWW.Example.com:80/a/b/?utm_source=x&b=2&a=1#top", "example.com/a/b?a=1&b=2"), ("https://example.com", "example.com"), ("HTTPS://example.com:443/?", "example.com"),
        ("http://example.com:8080/X", "example.com:8080/X"), ("  http://e.org/p//  ", "e.org/p"), ("http://e.org?sid=1&q=%20", "e.org?q=%20"),
        ("http://e.org/%41%7e%c3%a9%2F%zz%", "e.org/A~%C3%A9%2F%zz%"), ("http://E%65.org/a/./b/../c/.", "ee.org/a/c"), ("http://e.org/../../x/..", "e.org"), ("", None), (None, None), ("#x", None),
    ],
)
def test_canonical_url(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(revisit.canonical_url(F.col("u")).alias("k")).first()["k"] == key


def brute(rows):
    full = sorted((r[2], r[0], r) for r in rows if r[3] and r[1])
    out = []
    for r in rows:
        base = next((f for t, _, f in reversed(full) if r[1] and f[1] == r[1] and t < r[2]), None)
        h = dict(r[7] or {})
        if r[3]:
            out.append((r[0], "full", r[0], r[6], h))
            continue
        if base is None:
            out.append((r[0], "no_base", None, None, h))
            continue
        if r[4] and base[4]:
            same = r[4].removeprefix("W/") == base[4].removeprefix("W/")
        elif r[5] and base[5]:
            same = r[5] == base[5]
        else:
            same = r[6] == base[6] if r[6] and base[6] else None
        if r[6] and base[6] and r[6] != base[6]:
            same = False
        if same is False:
            out.append((r[0], "mismatch", None, None, h))
        else:
            merged = dict(base[7] or {}) | {k: v for k, v in h.items() if k in revisit.PERMITTED}
            out.append((r[0], "resolved" if same else "unchecked", base[0], base[6], merged))
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for i in range(700):
        url = "hot.org" if rng.random() < 0.5 else rng.choice(["a.org", "b.org/x", "c.org", None, "d.org"])
        pick = lambda *x: rng.choice(x)
        headers = pick(None, {}, {"date": str(i), "content-length": "5"}, {"etag": '"z"', "server": "s", "cache-control": "x"})
        rows.append((i, url, rng.randrange(200), rng.random() < 0.3, pick(None, '"1"', 'W/"1"', '"2"'), pick(None, "d1", "d2"), pick(None, "h1", "h2"), headers))
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = revisit.resolve(frame(spark, rows)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted((r["record_id"], r["outcome"], r["base_id"], r["digest"], r["headers"]) for r in got) == brute(rows)


def test_one_url_over_many_partitions(spark):
    """Only the very first record is full: it has to be carried through every partition."""
    rows = [(0, "u.org", 0, True, '"e"', None, "d", {})] + [(i, "u.org", i, False, '"e"', None, None, {}) for i in range(1, 300)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = revisit.resolve(frame(spark, rows).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {(r["outcome"], r["base_id"]) for r in got} == {("full", 0), ("resolved", 0)} and len(got) == 300


def test_empty_and_repeated(spark):
    assert revisit.resolve(frame(spark, [])).collect() == []
    twice = [(1, "a", 5, True, None, None, "d", None)] * 2 + [(2, "a", 6, None, None, None, None, None)] * 2
    assert [(r["outcome"], r["base_id"]) for r in revisit.resolve(frame(spark, twice)).orderBy("record_id").collect()] == [("full", 1)] * 2 + [("unchecked", 1)] * 2


def test_header_text(spark):
    df = spark.createDataFrame([({"b": "2", "a": None},)], "h map<string,string>")
    assert df.select(revisit.header_text("h").alias("t")).first()["t"] == "a: \nb: 2"
