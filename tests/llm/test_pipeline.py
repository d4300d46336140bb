"""The pipeline against the same steps done with plain Python, and its SQL twins."""

import hashlib
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lamina.llm import bpe, lang_id, mixing, queries, verdicts

from .test_near_dup import brute, shingle_set

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_against_plain_python(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = {r["doc_id"]: r for r in table.collect()}
    classify = lang_id.Classifier(lang_id.learn(table))
    kept = {}
    for i, r in docs.items():
        if classify.accepts(r["text"]):
            kept[i] = r["text"]
    last = {t: i for i, t in sorted(kept.items())}
    kept = {i: t for i, t in kept.items() if last[t] == i}
    kept = {i: kept[i] for i, _, _, ok in brute(sorted(kept.items())) if ok}

    frame = table.where(table.doc_id.isin(list(kept)))
    taken = {r["doc_id"]: (r["size"], r["taken"], r["spans"]) for r in mixing.mix_sources(frame).collect()}
    own = bpe.WordBPE(queries.tokenizer_file("word_bpe_49k.json"))
    want = []
    for i, t in kept.items():
        size, n, spans = taken[i]
        if n:
            text = "\n".join([t] * (n // size) + [" ".join(t.split()[s["start"] : s["end"]]) for s in spans])
            ids = own.encode_batch([text])[0]
            want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert sum(n for _, n, _ in taken.values()) == pytest.approx(sum(s for s, _, _ in taken.values()), rel=0.05)


def test_pipeline_takes_the_chosen_blocks(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        table = stage(spark, table, SF)
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    kept = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("doc_id").isin(list(texts)))
    want, parts = {}, 0
    for r in mixing.mix_sources(kept).collect():
        words = texts[r["doc_id"]].split()
        copies, rest = divmod(r["taken"], max(1, r["size"]))
        assert rest == sum(s["end"] - s["start"] for s in r["spans"])
        if r["taken"]:
            want[r["doc_id"]] = "\n".join([texts[r["doc_id"]]] * copies + [" ".join(words[s["start"] : s["end"]]) for s in r["spans"]])
        parts += any(s["end"] > rest for s in r["spans"])
    assert parts > 10
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.mix(spark, kept, SF).collect()} == want
    own = bpe.WordBPE(queries.tokenizer_file("word_bpe_49k.json"))
    ids = {i: hashlib.sha256(own.encode_batch([t])[0]).hexdigest() for i, t in want.items()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == ids


CLASH = {"size": 3, "taken": 9, "keep_id": 5, "group_size": 7, "spans": "s", "class": "c", "digest": "d", "kept": "k", "group": 1, "shard": 2, "id": 4, "target": 0.5}


def awkward(spark):
    """Null and shared ids, repeated rows, null, empty and blank texts, near copies, and columns with the names that operators use."""
    rng = random.Random(8)
    english = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' AND length(text) > 400").orderBy("doc_id").limit(8).collect()]
    near = [english[0] + " end", english[1] + " end", "Start " + english[1]]
    rows = [(5, "A"), (7, "A"), (5, "B"), (None, "A"), (None, "A"), (None, english[2]), (None, english[2]), (3, None), (3, None), (4, ""), (None, " \n")]
    rows += [(1, english[0]), (1, english[3]), (9, near[0]), (None, near[1]), (None, english[1]), (2, near[2]), (6, english[4]), (6, english[4]), (8, english[5]), (None, english[6])]
    rng.shuffle(rows)
    full = [(i, t, "en", rng.choice(("s", "t", None)), len(t or ""), *CLASH.values()) for i, t in rows]
    full += [full[0], full[3], full[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, size int, taken long, keep_id long, group_size long, spans string, `class` string, digest string, kept string, `group` int, shard int, id long, target double"
    return spark.createDataFrame(full, schema)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup_on_awkward_rows(spark):
    docs = awkward(spark)
    want = {}
    for r in rows_of(docs):
        ids = want.setdefault(r["text"] or "", [])
        ids.append(r["doc_id"])
    want = Counter((max((i for i in ids if i is not None), default=None), t) for t, ids in want.items())
    got = corpus_pipeline.exact_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in rows_of(got)) == want
    assert all({k: r[k] for k in CLASH} == CLASH for r in rows_of(got))


def test_near_dedup_on_awkward_rows(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in rows_of(docs)]
    groups = []  # classes as lists of rows
    for row in rows:
        own = shingle_set(row[1])
        if not own:
            groups.append([[row], None])
            continue
        same = [g for g in groups if g[1] is not None and any(100 * len(own & s) >= 85 * len(own | s) for s in g[1])]
        groups = [g for g in groups if g not in same] + [[[row, *(r for g in same for r in g[0])], [own, *(s for g in same for s in g[1])]]]
    got = Counter((r["doc_id"], r["text"]) for r in rows_of(corpus_pipeline.near_dedup(spark, docs, SF)))
    assert sum(got.values()) == len(groups)
    for members, _ in groups:
        name = min((i for i, _ in members if i is not None), default=None)
        stays = [r for r in members if r[0] == name]
        hit = next(r for r in stays if got[r] > 0)
        got[hit] -= 1
    assert not +got


def test_mix_on_awkward_rows(spark):
    docs = verdicts.materialize(awkward(spark), "awkward")
    named = {(r["__file"], r["__row"]): r for r in rows_of(verdicts.named(docs))}
    want, words = [], 0
    for v in mixing.mix_sources(verdicts.named(docs), keep=verdicts.NAME).collect():
        r = named.pop((v["__file"], v["__row"]))
        tokens = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        assert (v["doc_id"], v["size"]) == (r["doc_id"], len(tokens))
        words += v["taken"]
        if v["taken"]:
            text = "\n".join([r["text"]] * (v["taken"] // v["size"]) + [" ".join(tokens[s["start"] : s["end"]]) for s in v["spans"]])
            assert len(text.split()) == v["taken"]
            want.append(repr({**r, "text": text, "n_chars": len(text), "__file": 0, "__row": 0}))
    assert not named and words > 500
    got = [repr({**r, "__file": 0, "__row": 0}) for r in rows_of(corpus_pipeline.mix(spark, docs, SF))]
    assert sorted(got) == sorted(want) and any("'doc_id': None" in r for r in got)


def test_language_and_bpe_on_awkward_rows(spark):
    docs = awkward(spark)
    classify = lang_id.Classifier(lang_id.learn(docs))
    want = Counter(repr(r) for r in rows_of(docs) if classify.accepts(r["text"]))
    assert Counter(repr(r) for r in rows_of(corpus_pipeline.language(spark, docs, SF))) == want
    own = bpe.WordBPE(queries.tokenizer_file("word_bpe_49k.json"))
    want = Counter((r["doc_id"], hashlib.sha256(own.encode_batch([r["text"] or ""])[0]).hexdigest()) for r in rows_of(docs))
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in rows_of(corpus_pipeline.encode(spark, docs, SF))) == want


def test_run_leaves_one_folder(spark):
    from lamina import session

    before = list(session._LOOSE)
    frame = corpus_pipeline.run(spark, SF)
    new = [p for p in session._LOOSE if p not in before]
    assert len(new) == 1 and "stage-mix_sources" in new[0] and frame.count() > 0
    session.clean(spark)
    assert not os.path.exists(new[0]) and session._LOOSE == []


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_twins(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    r = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in r.description]
    order = [columns.index(x) for x in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(row[i] for i in order)) for row in r.fetchall())


def test_every_query_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))


def test_ids_are_little_endian():
    assert np.frombuffer(bpe.WordBPE(queries.tokenizer_file("word_bpe_49k.json")).encode_batch(["the"])[0], "<u4").tolist() != []
