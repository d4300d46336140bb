"""Near-duplicate classes: MinHash bands, sequential Bayesian verification of signatures, exact confirmation.

Steps, all over whole texts:

1. Texts become sets of word shingles; equal sets collapse to one representative each (the first of their rows), so copies never
   meet each other again. A representative keeps its signature, not its set. Representatives are named by a number of their own,
   never by a doc_id, so null and repeated ids lose no link.
2. Signatures are cut into bands; a band value shared by several representatives is a bucket. The bucket's smallest number is its
   centre. Every member is compared with the centre: linear in the members, whatever the size of a bucket.
3. A comparison looks at a batch of signature positions at a time and stops as soon as the posterior probability (uniform
   prior) of a similarity at the threshold or above falls below `miss`. Survivors are confirmed on their full sets.
4. Confirmed links give components. In each bucket that still holds several, the members outside its largest component are
   compared with `CENTRES` of that component's members, drawn by hash: again linear in the members. This is done `ROUNDS`
   times, so in a large group of near copies nearly all that belong together are joined.
5. What is still open is settled pair by pair: members outside the bucket's largest component against all that are in another
   component, in square blocks, so a task holds a bounded number of rows and bytes however large the bucket is. A pair is looked
   at in the first band it shares only. Blocks of signatures tell first which members have a partner that isn't pruned; only those
   are sent once more with their sets and confirmed in place, so only links leave a block, fewer than it has rows. Nothing is
   capped, and what has been joined costs nothing more.
6. All links together give the final components, named by their smallest doc_id.

The chance to lose a link at similarity s is that of sharing no band, (1 - s**rows) ** bands (4e-7 at 0.85 by default), plus
that of being pruned (about `miss` for each batch).

Defined edge cases: a null text, or one without words, has an empty set and is linked with nothing; fewer than `width` words
make one shingle; rows are classified each by its text, so rows that share a doc_id but not their text may be in different
components (both are then named by that id or a smaller one), and repeated rows get equal rows; rows with a null doc_id are
classified like any other but never name a component unless all of it is without ids (then its name is null); `kept` is true for
every row whose doc_id is its component's name, also if several share it; an empty table gives an empty result; extra columns
pass by, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.shingles import MinHasher, jaccard_at_least, mix64, shingle_sets
from lamina.llm.verdicts import NAME, named
from lamina.session import materialize, scope, spread

WIDTH, PERCENT = 5, 85
BANDS, ROWS, SIGNATURE, BATCH = 20, 4, 128, 16
MISS = 1e-6
#: Members of a component that others are compared with in step 4, and how often.
CENTRES, ROUNDS = 8, 1
#: Rows of a side of a block in step 5, and the bytes of their sets, on average.
BLOCK, BLOCK_BYTES = 1_024, 8 << 20
#: Ids of documents to be read again are broadcast up to this many (8 bytes each), else joined by a shuffle.
BROADCAST_IDS = 500_000


def least_matches(percent: int = PERCENT, miss: float = MISS, size: int = SIGNATURE, batch: int = BATCH) -> list[tuple[int, int]]:
    """(n, fewest matches among the first n positions with which P(similarity >= percent / 100) is at least `miss`)."""
    out, s = [], percent / 100
    for n in range(batch, size + 1, batch):
        tail, m = 0.0, 0
        for m in range(n + 1):
            # Posterior Beta(m + 1, n - m + 1): P(S >= s) = P(Binomial(n + 1, s) <= m).
            tail += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
            if tail >= miss:
                break
        out.append((n, m))
    return out


def survivors(a: np.ndarray, b: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the rows of two aligned signature matrices that no batch prunes."""
    alive, got, at = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, least in limits:
        got = got + (a[alive, at:n] == b[alive, at:n]).sum(1, dtype=np.int32)
        keep = got >= least
        alive, got, at = alive[keep], got[keep], n
    return alive


def _order(size: int) -> np.ndarray:
    """Positions as they are compared: those outside the bands first, as they aren't biased by sharing a band."""
    return np.concatenate([np.arange(BANDS * ROWS, size), np.arange(min(size, BANDS * ROWS))])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, order = MinHasher(SIGNATURE), _order(SIGNATURE)
    salt = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        sizes, digests, sigs, bands = [], [], [], []
        for s in shingle_sets(texts):
            sizes.append(len(s))
            if not len(s):
                digests.append(None)
                sigs.append(None)
                bands.append(None)
                continue
            # Two sums of independent mixes name the set; equal sets are equal arrays.
            digests.append(np.array([mix64(s).sum(dtype=np.uint64), mix64(s ^ salt[0]).sum(dtype=np.uint64), len(s)], np.uint64).tobytes())
            m = hasher(s)
            sigs.append(m[order].tobytes())
            v = m[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
            key = salt.copy()
            for r in range(ROWS):
                key = mix64(key ^ v[:, r])
            bands.append(key.view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", *NAME, "n_shingles", "digest", "sig", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())], names=["id", "set"])


def _pruned(percent: int):
    limits = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, SIGNATURE) for c in (2, 3))
                keep = pa.array(survivors(a, b, limits))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3)]
            keep = pa.array([i for i, (x, y) in enumerate(zip(*sets, strict=True)) if jaccard_at_least(x, y, percent)[0]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return run


def _asks(rows: pd.DataFrame, minor: pd.DataFrame, limits: list[tuple[int, int]]) -> Iterator[tuple[int, np.ndarray]]:
    """Of one block of step 5: each row of `minor`, by its place, with the places of the `rows` that it is to be confirmed with."""
    if rows.empty or minor.empty:
        return
    key, centre = int(rows["key"].iloc[0]), int(rows["centre"].iloc[0])
    ids, comp, is_minor = rows["id"].to_numpy(np.int64), rows["comp"].to_numpy(np.int64), rows["minor"].to_numpy(bool)
    sig = np.frombuffer(b"".join(rows["sig"]), np.uint32).reshape(-1, SIGNATURE)
    bands = np.stack(rows["bands"].to_numpy()).astype(np.int64)
    for n, (i, c, s, own) in enumerate(zip(minor["id"].tolist(), minor["comp"], minor["sig"], minor["bands"], strict=True)):
        if i == centre:
            continue
        # Between two minor rows the smaller id asks; rows of the largest component are asked by every minor row.
        at = np.flatnonzero((comp != c) & (ids != centre) & (~is_minor | (ids > i)))
        if len(at):
            own = np.asarray(own, np.int64)
            at = at[own[(bands[at] == own).argmax(1)] == key]
            mine = np.frombuffer(s, np.uint32)
            at = at[survivors(sig[at], np.broadcast_to(mine, (len(at), SIGNATURE)), limits)]
        if len(at):
            yield n, at


def _wanted(percent: int):
    """The rows of one block that aren't pruned by every partner, from signatures alone."""
    limits = least_matches(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, minor = pdf[~pdf["as_minor"]], pdf[pdf["as_minor"]]
        of_rows, of_minor = np.zeros(len(rows), bool), np.zeros(len(minor), bool)
        for n, at in _asks(rows, minor, limits):
            of_rows[at] = of_minor[n] = True
        return pd.concat([rows[of_rows], minor[of_minor]])[["key", "x", "y", "as_minor", "id"]]

    return run


def _blocks(percent: int):
    """Confirm the pairs of one block, unless something has joined them already; of the links found, those that join anything in the
    block are returned."""
    limits = least_matches(percent)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, minor = pdf[~pdf["as_minor"]], pdf[pdf["as_minor"]]
        ids, sets, own_ids, own_sets = rows["id"].tolist(), rows["set"].tolist(), minor["id"].tolist(), minor["set"].tolist()
        links: list[tuple[int, int]] = []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for n, at in _asks(rows, minor, limits):
            i, words = own_ids[n], np.frombuffer(own_sets[n], np.uint64)
            for j in at.tolist():
                if root(i) != root(ids[j]) and jaccard_at_least(words, np.frombuffer(sets[j], np.uint64), percent)[0]:
                    links.append((min(i, ids[j]), max(i, ids[j])))
                    parent[root(i)] = root(ids[j])
        return pd.DataFrame(links, columns=["a", "b"]).astype("int64")

    return run


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over `edges` (a, b), for every id that has an edge.

    Each round every root takes the smallest of its neighbours' roots, chains of such choices are shortened by
    doubling, and the edges contract to the new roots, until none is left. All of it is joins and aggregations.
    """
    edges = materialize(edges.select("a", "b").distinct(), "cc-edges")
    label = materialize(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().withColumn("comp", F.col("id")), "cc-label")
    while edges.limit(1).count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("id"), F.least("a", "to").alias("to"))
        hook = materialize(hook, "cc-hook")
        while True:
            jump = hook.select(F.col("id").alias("to"), F.col("to").alias("far"))
            longer = materialize(hook.join(jump, "to").select("id", F.col("far").alias("to"), (F.col("far") != F.col("to")).alias("moved")), "cc-jump")
            moved = longer.where("moved").limit(1).count()
            hook = longer.select("id", "to")
            if not moved:
                break
        step = hook.withColumnsRenamed({"id": "comp", "to": "next"})
        label = materialize(label.join(step, "comp", "left").select("id", F.coalesce("next", "comp").alias("comp")), "cc-label")
        ends = edges.join(hook.withColumnsRenamed({"id": "a", "to": "ra"}), "a").join(hook.withColumnsRenamed({"id": "b", "to": "rb"}), "b")
        edges = materialize(ends.where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "cc-edges")
    return label


def _prune(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    left = sigs.select(F.col("id").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("id").alias("b"), F.col("sig").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_pruned(percent), "a long, b long")


def _confirm(pairs: DataFrame, places: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    sets = _sets_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), places, docs)
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(_confirmed(percent), "a long, b long")


def _sets_of(ids: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, set) of the representatives named, made again from the texts of their rows (`places`: id and `NAME`)."""
    rows = materialize(ids.distinct().join(places, "id"), "pair-ids")
    small = rows.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(rows) if small else rows, NAME).select("id", "text")
    return materialize(texts.mapInArrow(_sets, "id long, set binary"), "pair-sets")


def _open(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, with comp, the bucket's rows, those of its largest component
    (`most`) and whether the member is outside that (`minor`)."""
    wide = members.where("n > 2").join(label, "id", "left").select("key", "id", "centre", F.coalesce("comp", "id").alias("comp"))
    counts = wide.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    major = counts.groupBy("key").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("major"), F.sum("m").alias("rows"), F.max("m").alias("most"))
    # Written, so that both sides of the join are plain exchanges and a hot bucket is split between tasks.
    open_ = wide.join(materialize(major.where("rows > most"), "near-major"), "key").withColumn("minor", F.col("comp") != F.col("major"))
    return materialize(open_, "near-open")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, rows: bool = False) -> DataFrame:
    """Classes of `docs` (doc_id, text) under links of similarity `percent` / 100 or more.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable), kept (doc_id = component_id). With `rows`, `docs` comes
    from `verdicts.named`, and the result has its names and `class`, a number of the component, null for an empty set.
    """
    spark = docs.sparkSession
    with scope(spark):
        docs = (docs if rows else named(docs.select("doc_id", "text"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", *NAME)
        kinds = f"doc_id long, {NAME[0]} long, {NAME[1]} long, n_shingles long, digest binary, sig binary, bands array<long>"
        base = materialize(docs.mapInArrow(_signatures, kinds).withColumn("no", F.monotonically_increasing_id()), "near-base", outer=1)
        filled = base.where("digest IS NOT NULL")
        reps = materialize(filled.groupBy("digest").agg(F.min("no").alias("id"), F.min("doc_id").alias("doc")), "near-reps")
        label = _labels(docs, filled, reps, percent)
        classes = reps.join(label, "id", "left").select("digest", "doc", "comp", F.coalesce("comp", "id").alias("class"))
        names = classes.where("comp IS NOT NULL").groupBy("class").agg(F.min("doc").alias("name"))
        classes = classes.join(names, "class", "left").select("digest", "class", F.when(F.col("comp").isNull(), F.col("doc")).otherwise(F.col("name")).alias("component_id"))
        classes = materialize(classes, "near-named", outer=1)
        # Copies: a set with a large share of the rows is one of few, by counting, and is broadcast; the rest is shuffled.
        sizes = filled.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
        heavy = sizes.where(F.col("copies") > max(1, base.count() // 1000)).join(classes, "digest").select("digest", "class", "component_id")
        heavy = materialize(heavy, "near-heavy", outer=1)
    columns = ["doc_id", "n_shingles", "class", "component_id", *NAME]
    plain = base.select("doc_id", "n_shingles", "digest", *NAME)
    marked = plain.where("digest IS NOT NULL").join(F.broadcast(heavy), "digest", "left")
    light = marked.where("class IS NULL").drop("class", "component_id").join(classes, "digest", "left").select(*columns)
    out = marked.where("class IS NOT NULL").select(*columns).unionByName(light)
    out = out.unionByName(plain.where("digest IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("class"), F.col("doc_id").alias("component_id"), *NAME))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return out if rows else out.select("doc_id", "n_shingles", "component_id", "kept")


def _labels(docs: DataFrame, filled: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(id, comp) of the representatives `reps` that have a link: steps 2 to 6."""
    own = filled.select(F.col("no").alias("id"), "n_shingles", "sig", "bands", *NAME)
    sigs = materialize(own.join(reps.select("id"), "id"), "near-sigs")
    places = sigs.select("id", *NAME)

    keys = sigs.select("id", F.explode("bands").alias("key"))
    buckets = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).where("n > 1"), "near-buckets")
    members = materialize(keys.join(buckets, "key").select("key", "id", "centre", "n"), "near-members")
    star = members.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    links = materialize(_confirm(materialize(_prune(star, sigs, percent), "near-pairs"), places, docs, percent), "near-links")
    label = components(links)

    for _ in range(ROUNDS):
        open_ = _open(members, label)
        drawn = [F.min_by("id", F.xxhash64("id", F.lit(k))).alias(f"c{k}") for k in range(CENTRES)]
        centres = open_.where("NOT minor").groupBy("key").agg(*drawn)
        centres = materialize(centres, "near-centres").select("key", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)]))).alias("c"))
        pairs = open_.where("minor AND id <> centre").join(centres, "key").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"))
        pairs = materialize(_prune(pairs.distinct().join(links, ["a", "b"], "left_anti"), sigs, percent), "near-pairs")
        more = materialize(_confirm(pairs, places, docs, percent), "near-links")
        if not more.limit(1).count():
            break
        links = materialize(links.union(more), "near-links")
        label = components(links)

    work = materialize(_work(_open(members, label), sigs), "near-work")
    data = sigs.select("id", "sig", "bands")
    kinds = "key long, x int, y int, as_minor boolean, id long"
    wanted = materialize(spread(work.join(data, "id"), "key", "x", "y").groupBy("key", "x", "y").applyInPandas(_wanted(percent), kinds), "near-wanted")
    sets = _sets_of(wanted.select("id"), places, docs)
    block = work.join(wanted, ["key", "x", "y", "as_minor", "id"], "left_semi").join(data.join(sets, "id"), "id")
    found = materialize(spread(block, "key", "x", "y").groupBy("key", "x", "y").applyInPandas(_blocks(percent), "a long, b long"), "near-links")
    return components(links.union(found)) if found.limit(1).count() else label


def _work(open_: DataFrame, sigs: DataFrame) -> DataFrame:
    """The members of open buckets dealt to blocks (key, x, y): each as a row of every x, minor ones also as askers of every y. There
    are as many x and y as rows and bytes of sets ask for."""
    sized = open_.join(sigs.select("id", "n_shingles"), "id")
    large = sized.groupBy("key").agg(F.sum(F.col("n_shingles") * 8).alias("bytes"), F.sum(F.when(F.col("minor"), F.col("n_shingles") * 8)).alias("minor_bytes"))
    parts = lambda rows, size: F.ceil(F.greatest(F.col(rows) / BLOCK, F.col(size) / BLOCK_BYTES)).cast("int")
    # Written, so that both sides of the join are plain exchanges and a hot bucket is split between tasks.
    blocks = open_.join(materialize(large, "near-large"), "key").withColumn("minors", F.col("rows") - F.col("most"))
    blocks = blocks.withColumn("na", parts("minors", "minor_bytes")).withColumn("nb", parts("rows", "bytes")).withColumn("h", F.xxhash64("id"))
    columns = ["key", "id", "centre", "comp", "minor"]
    as_row = blocks.select(*columns, F.lit(False).alias("as_minor"), F.explode(F.expr("sequence(0, na - 1)")).alias("x"), F.expr("cast(pmod(h, nb) as int)").alias("y"))
    as_minor = blocks.where("minor").select(*columns, F.lit(True).alias("as_minor"), F.expr("cast(pmod(h, na) as int)").alias("x"), F.explode(F.expr("sequence(0, nb - 1)")).alias("y"))
    return as_row.union(as_minor)
