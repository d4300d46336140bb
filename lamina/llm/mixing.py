"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The documents of a source are laid out as a stream of words, cut into shards and each shard into blocks of about
`block_words` words. Two apportionments hand out whole blocks, both by the highest quotients w / (2k + 1):

1. between the sources: as many blocks as the targets ask for, by the sources' targets (in blocks);
2. for each source, between its shards: its quota, by the shards' block counts.

A shard then repeats every block `quota // blocks` times and a seeded choice of its blocks once more. No quotient beyond
`max_repeat` times the blocks is a candidate, so no block and thus no document is taken more than `max_repeat` times.
What is taken of a document is thus a number of whole copies and, once more, its words in the blocks of that choice: these
are its `spans`, ranges [start, end) of its words in order, with neighbouring blocks as one.

Only (doc_id, source, size) and the columns that the caller wants back are shuffled, never a text. A shard holds at most about `shard_words` words until a source
needs more than `max_shards` of them, so a source with a third of all rows spreads over as many tasks as its size asks
for. The table of sources (one row each) is on the driver while it has at most `MAX_SOURCES` rows, which is checked; beyond, targets and
quotas come from `many_sources`, with the same result, and the table is joined instead of broadcast.

Defined edge cases: a null text has size 0, as has one of white space only, and takes 0; a null source is a source of its
own and comes last; an empty table gives an empty result; rows that repeat a doc_id count as rows of their own and are told
apart by a hash of their text, and rows that are equal in that too by the columns `keep` or else interchangeable; other columns pass by,
whatever their names.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import many_sources
from lamina.session import materialize

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 32
SHARD_WORDS = 1 << 17
MAX_SHARDS = 1 << 16
MAX_REPEAT = 3
MAX_SOURCES = 100_000
#: Beyond that, sources with one of so many rows are broadcast all the same: there are no more of them than this.
HOT_SHARE = 1_000
SEED = "mix-1"


def targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEAT) -> list[float]:
    """Share the total of `sizes` by weight; what would exceed `cap` times a size is reshared among the others by weight."""
    left, open_, out = float(sum(sizes)), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if unit * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        gone = set(over)
        open_ = [i for i in open_ if i not in gone]
    return out


def sainte_lague(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Seats by the highest quotients w / (2k + 1), with at most `most[i]` for i; ties go to the lower index.

    A divisor start gives each its seats but a few by rounding down, so the heap hands out O(n) seats, not O(seats).
    """
    seats = min(seats, sum(m for m, w in zip(most, weights, strict=True) if w > 0))
    total = math.fsum(weights)
    if seats <= 0 or total <= 0:
        return [0] * len(weights)
    # With divisor d, every quotient w / (2k + 1) > d is among the highest as long as there are no more of them than seats.
    got, d = [], max(total / (2 * seats), 5e-324)
    for _ in range(200):
        got = [min(m, max(0, math.floor((w / d + 1) / 2 - 1e-9))) for w, m in zip(weights, most, strict=True)]
        if sum(got) <= seats:
            break
        d *= 1.0 + 1.0 / 64
    if sum(got) > seats:
        got = [0] * len(weights)
    heap = [(-w / (2 * g + 1), i) for i, (w, g, m) in enumerate(zip(weights, got, most, strict=True)) if g < m and w > 0]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-weights[i] / (2 * got[i] + 1), i))
    return got


def word_count(text) -> F.Column:
    """Number of runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _shard_quotas(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one source: its quota over its shards."""
    pdf = pdf.sort_values("shard", kind="stable").reset_index(drop=True)
    blocks = [int(b) for b in pdf["blocks"]]
    quota = int(pdf["source_quota"].iloc[0])
    pdf["quota"] = sainte_lague([float(b) for b in blocks], quota, [int(m) * b for m, b in zip(pdf["max_repeat"], blocks, strict=True)])
    return pdf[["src", "shard", "blocks", "quota"]]


def _take(pdf: pd.DataFrame) -> pd.DataFrame:
    """For one shard: lay out its documents in seeded order, choose blocks, and find the words taken of each document."""
    pdf = pdf.sort_values(["ord", "doc_id", "size"], kind="stable", na_position="last").reset_index(drop=True)
    size = pdf["size"].to_numpy(np.int64)
    n, quota, total = int(pdf["blocks"].iloc[0]), int(pdf["quota"].iloc[0]), int(size.sum())
    if total == 0 or n == 0:
        pdf["taken"] = np.int64(0)
        pdf["start"] = pdf["end"] = [[]] * len(pdf)
        return pdf[["doc_id", "src", "size", "taken", "start", "end"]]
    once_more = np.zeros(n, np.int64)
    rng = np.random.default_rng([int(pdf["seed"].iloc[0]) & 0x7FFFFFFF, int(pdf["shard"].iloc[0])])
    once_more[rng.permutation(n)[: quota % n]] = 1
    repeat = quota // n + once_more
    edge = np.arange(n + 1, dtype=np.int64) * total // n
    upto = np.concatenate(([0], np.cumsum(repeat * np.diff(edge))))

    def taken_before(pos: np.ndarray) -> np.ndarray:
        block = np.clip(np.searchsorted(edge, pos, side="right") - 1, 0, n - 1)
        return upto[block] + repeat[block] * (pos - edge[block])

    end = np.cumsum(size)
    pdf["taken"] = taken_before(end) - taken_before(end - size)
    pdf["start"], pdf["end"] = _spans(end - size, end, edge, once_more)
    return pdf[["doc_id", "src", "size", "taken", "start", "end"]]


#: Names of columns while the caller's own are beside them.
_OWN = {"__doc": "doc_id", "__no": "src", "__size": "size", "__ord": "ord", "__shard": "shard", "__blocks": "blocks", "__quota": "quota", "__seed": "seed"}
_PLAN = "__no int, __source string, __source_size long, __target double, __shards int"
_TAKEN = "__doc long, __no int, __size long, __taken long, __start array<int>, __end array<int>"


def _take_beside(pdf: pd.DataFrame, keep: list[str]) -> pd.DataFrame:
    """`_take` with the columns `keep` beside, which also order rows that are equal in all else."""
    pdf = pdf.sort_values(["__ord", "__doc", "__size", *keep], kind="stable", na_position="last").reset_index(drop=True)
    out = _take(pdf[list(_OWN)].rename(columns=_OWN))
    out.columns = ["__doc", "__no", "__size", "__taken", "__start", "__end"]
    return pd.concat([out, pdf[keep]], axis=1)


def _spans(begin: np.ndarray, end: np.ndarray, edge: np.ndarray, chosen: np.ndarray) -> tuple[list, list]:
    """Where the words [begin, end) of each document lie in the chosen blocks: starts and ends, counted from the document's first word.

    None for a document that they cover: its words are a whole copy.
    """
    step = np.diff(chosen, prepend=0, append=0)
    run_start, run_end = edge[np.flatnonzero(step == 1)], edge[np.flatnonzero(step == -1)]
    first, last = np.searchsorted(run_end, begin, side="right"), np.searchsorted(run_start, end, side="left")
    starts, ends = [], []
    for b, e, i, j in zip(begin.tolist(), end.tolist(), first.tolist(), last.tolist(), strict=True):
        if b == e or (j - i == 1 and run_start[i] <= b and e <= run_end[i]):
            j = i
        starts.append(np.maximum(run_start[i:j], b) - b)
        ends.append(np.minimum(run_end[i:j], e) - b)
    return starts, ends


def _few_sources(spark: SparkSession, found: list, weights: tuple[float, ...], shard_words: int, max_shards: int, max_repeat: int) -> DataFrame:
    """Number, size, target and shards of the sources `found`, worked out on the driver."""
    found = sorted(((r["__src"], r["words"]) for r in found), key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8")))
    sizes = [w for _, w in found]
    goal = targets(sizes, list(itertools.islice(itertools.cycle(weights), len(found))), max_repeat)
    shards = [min(max_shards, max(1, math.ceil(w / shard_words))) for w in sizes]
    return spark.createDataFrame([(i, s, int(w), float(g), k) for i, ((s, w), g, k) in enumerate(zip(found, goal, shards, strict=True))], _PLAN)


def _many_sources(by_source: DataFrame, weights: tuple[float, ...], shard_words: int, max_shards: int, max_repeat: int) -> DataFrame:
    """The same for any number of sources."""
    sources = materialize(many_sources.numbered(by_source.withColumnRenamed("words", "size"), "__src", weights), "mix-sources")
    shards = F.least(F.lit(max_shards), F.greatest(F.lit(1), F.ceil(F.col("size") / shard_words))).cast("int")
    plan = many_sources.targets(sources, max_repeat).select("no", "__src", "size", "target", shards, "rows").toDF("__no", "__source", "__source_size", "__target", "__shards", "rows")
    return materialize(plan, "mix-plan")


def _few_quotas(spark: SparkSession, wanted: DataFrame, max_repeat: int) -> DataFrame:
    """Quotas of the sources `wanted` (no, w, most), worked out on the driver."""
    rows = sorted(wanted.collect())
    quota = sainte_lague([r["w"] for r in rows], round(math.fsum(r["w"] for r in rows)), [r["most"] for r in rows])
    return F.broadcast(spark.createDataFrame([(r["no"], int(q), max_repeat) for r, q in zip(rows, quota, strict=True)], "__no int, source_quota long, max_repeat int"))


def _many_quotas(wanted: DataFrame, max_repeat: int) -> DataFrame:
    """The same for any number of sources."""
    # Whole numbers of 2^-20 blocks, so that the sum is the same in any order.
    total = wanted.agg(F.sum(F.round(F.col("w") * (1 << 20)).cast("decimal(38,0)")).alias("t")).first()["t"] or 0
    quota = many_sources.seats(wanted, round(total / (1 << 20)))
    return quota.select(F.col("no").alias("__no"), F.col("seats").alias("source_quota"), F.lit(max_repeat).alias("max_repeat"))


def _with_sources(rows: DataFrame, plan: DataFrame, many: bool) -> DataFrame:
    """`rows` with `__no` and `__shards` of their source. Of many sources, those with many rows are broadcast and the rest merged."""
    source = rows["__src"].eqNullSafe(plan["__source"])
    if not many:
        return rows.join(F.broadcast(plan.select("__no", "__source", "__shards")), source, "inner").drop("__src", "__source")
    n = rows.count()
    hot = plan.where(F.col("rows") * HOT_SHARE >= n).select("__no", "__source", "__shards")
    found = rows.join(F.broadcast(hot), rows["__src"].eqNullSafe(hot["__source"]), "left")
    cold = found.where("__no IS NULL").drop("__no", "__source", "__shards")
    other = plan.where(F.col("rows") * HOT_SHARE < n).select("__no", "__source", "__shards").hint("merge")
    merged = cold.join(other, cold["__src"].eqNullSafe(other["__source"]), "inner")
    return found.where("__no IS NOT NULL").unionByName(merged).drop("__src", "__source")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
    max_shards: int = MAX_SHARDS, max_repeat: int = MAX_REPEAT, seed: str = SEED, keep: Sequence[str] = (), max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """Which words of each of `docs` (doc_id, text, source) the mix takes, and how many.

    Sources by code point, null last, weigh `weights`, repeating. Returns doc_id, size, source_size, target, taken, source, spans and
    the columns `keep` (numbers or strings); `taken` is the words of whole copies and of the spans (see above), and no span if whole
    copies are all. With more than `max_sources` sources none of their tables is on the driver; what is taken is the same.
    """
    spark, keep = docs.sparkSession, list(keep)
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("__doc"), F.col("source").alias("__src"), word_count(text).alias("__size"),
        F.xxhash64(F.lit(seed), "doc_id", F.crc32(F.coalesce(text, F.lit("")).cast("binary"))).alias("__ord"), *keep,
    )
    rows = materialize(rows, "mix-sizes")
    by_source = rows.groupBy("__src").agg(F.sum("__size").alias("words"), F.count(F.lit(1)).alias("rows"))
    found = by_source.limit(max_sources + 1).collect()
    many = len(found) > max_sources
    cut = (weights, shard_words, max_shards, max_repeat)
    plan = _many_sources(by_source, *cut) if many else _few_sources(spark, found, *cut)
    placed = _with_sources(rows, plan, many)
    placed = placed.withColumn("__shard", F.pmod(F.col("__ord"), F.col("__shards")).cast("int"))
    per_shard = placed.groupBy("__no", "__shard").agg(F.sum("__size").alias("words"))
    blocks_of = F.when(F.col("words") == 0, 0).otherwise(F.greatest(F.lit(1), F.round(F.col("words") / block_words))).cast("long")
    per_shard = materialize(per_shard.withColumn("blocks", blocks_of), "mix-shards")
    n_blocks = per_shard.groupBy("__no").agg(F.sum("blocks").alias("b"))
    share = F.when(F.col("__source_size") > 0, F.col("__target") * F.col("b") / F.col("__source_size")).otherwise(0.0)
    wanted = n_blocks.join(plan, "__no").select(F.col("__no").alias("no"), share.alias("w"), (max_repeat * F.col("b")).alias("most"))
    quotas = _many_quotas(materialize(wanted, "mix-wanted"), max_repeat) if many else _few_quotas(spark, wanted, max_repeat)
    shard_plan = (
        per_shard.join(quotas, "__no")
        .select(F.col("__no").alias("src"), F.col("__shard").alias("shard"), "blocks", "source_quota", "max_repeat")
        .groupBy("src").applyInPandas(_shard_quotas, "src int, shard int, blocks long, quota long")
    )
    shard_plan = materialize(shard_plan.toDF("__no", "__shard", "__blocks", "__quota"), "mix-quotas")
    named = plan.select("__no", "__source", "__source_size", "__target")
    if many:
        # Rows get what is known of their source with their shard, of which none is large.
        shard_plan = shard_plan.join(named, "__no")
    beside = [*keep, *(["__source", "__source_size", "__target"] if many else [])]
    seed_no = F.abs(F.xxhash64(F.lit(seed), F.col("__no"))) % F.lit(2_147_483_647)
    laid = placed.drop("__shards").join(shard_plan, ["__no", "__shard"]).withColumn("__seed", seed_no)
    kinds = "".join(f", `{c}` {laid.schema[c].dataType.simpleString()}" for c in beside)
    taken = laid.groupBy("__no", "__shard").applyInPandas(lambda pdf: _take_beside(pdf, beside), _TAKEN + kinds)
    if not many:
        taken = taken.join(F.broadcast(named), "__no")
    return taken.select(
        F.col("__doc").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        F.col("__taken").alias("taken"), F.col("__source").alias("source"),
        F.arrays_zip(F.col("__start").alias("start"), F.col("__end").alias("end")).alias("spans"), *keep,
    )


def mixed_text(text, size, taken, spans=None) -> F.Column:
    """The words that the mix takes of a text: whole copies, then `spans`, each part after a line end.

    Only without `spans`, for who has no more than a count, are the words beyond whole copies the first ones. A null text, or one that
    nothing is taken of, gives the empty text.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = F.greatest(size, F.lit(1))
    copies, rest = F.floor(taken / some).cast("int"), (taken % some).cast("int")
    if spans is None:
        spans = F.array(F.struct(F.lit(0).alias("start"), rest.alias("end")))
    whole = F.when(copies > 0, F.array_join(F.array_repeat(text, copies), "\n"))
    # As the variable of a lambda, the split text is made once, not for each span.
    cut = lambda w: F.array_join(F.transform(spans, lambda s: F.array_join(F.slice(w, s["start"] + 1, s["end"] - s["start"]), " ")), "\n")
    part = F.when(rest > 0, F.transform(F.array(words), cut)[0])
    return F.concat_ws("\n", whole, part)
