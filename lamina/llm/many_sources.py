"""The arithmetic of `mixing` for more sources than a driver should hold: the same targets and the same seats, by DataFrame.

Thresholds are found by aggregates over the table of sources, several trial values in one pass, so that what the driver sees is a few numbers
a pass. Results are those of `mixing.targets` and `mixing.sainte_lague`, ties included; weights are positive whole numbers. Empty
tables give empty tables. Callers hand over written frames, as each is read many times.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import materialize, partitions

#: Trial values in one pass.
WAYS = 64


def numbered(sources: DataFrame, column: str, weights: tuple[float, ...]) -> DataFrame:
    """`sources`, one row for each value of `column`, with its number `no` by code point, null last, and its `weight`, `weights` repeating."""
    order = F.col(column).asc_nulls_last()
    placed = materialize(sources.repartitionByRange(partitions(sources.sparkSession), order).withColumn("part", F.spark_partition_id()), "mix-placed")
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):  # one row a partition
        offsets.append((r["part"], before))
        before += r["count"]
    at = F.broadcast(sources.sparkSession.createDataFrame(offsets, "part int, before long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    out = placed.withColumn("within", within).join(at, "part").withColumn("no", (F.col("before") + F.col("within")).cast("int"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return out.withColumn("weight", F.get(cycle, F.pmod("no", F.lit(len(weights))))).drop("part", "within", "before")


def targets(sources: DataFrame, cap: int) -> DataFrame:
    """`sources` (size, weight, ..) with `target`: the total shared by weight, what exceeds `cap` times a size reshared among the rest.

    The share of a unit of weight only rises as sources reach their cap, so who has reached it follows from the last one.
    """
    unit, closed_before = 0.0, -1
    most = cap * F.col("size")
    while True:
        closed = F.lit(unit) * F.col("weight") > most
        r = sources.agg(
            F.sum("size").alias("total"), F.coalesce(F.sum(F.when(closed, most)), F.lit(0)).alias("gone"), F.sum(F.when(~closed, F.col("weight"))).alias("open"),
            F.count_if(closed).alias("closed"),
        ).first()
        if r["closed"] == closed_before or not r["open"]:
            return sources.withColumn("target", F.when(closed, most.cast("double")).otherwise(F.lit(unit) * F.col("weight")))
        unit, closed_before = (float(r["total"]) - r["gone"]) / r["open"], r["closed"]


def _bits(x: float) -> int:
    return struct.unpack("<q", struct.pack("<d", x))[0]


def _float(bits: int) -> float:
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def _first(low: int, high: int, passes: Callable[[list[int]], list[bool]]) -> int:
    """The least whole number above `low` that passes; all above it pass, and `high` is known to."""
    while high - low > 1:
        probes = sorted({low + (high - low) * i // (WAYS + 1) for i in range(1, WAYS + 1)} - {low, high}) or [low + 1]
        for probe, yes in zip(probes, passes(probes), strict=True):
            if yes:
                high = probe
                break
            low = probe
    return high


def _above(d):
    """How many of the quotients w / (2k + 1), k below `most`, are higher than the column `d`."""
    w, most = F.col("w"), F.col("most")
    near = F.floor(F.least(most.cast("double"), (w / d + 1) / 2)).cast("long")
    more = F.when((near < most) & (w / (2 * near + 1) > d), 1).otherwise(0)
    less = F.when((near > 0) & (w / (2 * near - 1) <= d), 1).otherwise(0)
    return F.when(w > 0, near + more - less).otherwise(0).cast("long")


def seats(rows: DataFrame, wanted: int) -> DataFrame:
    """(no, seats) of `rows` (no, w, most): `wanted` seats by the highest quotients, at most `most` for each; ties go to the lower number."""
    room = rows.where("w > 0").agg(F.coalesce(F.sum("most"), F.lit(0)).alias("room"), F.max("w").alias("top")).first()
    wanted = min(wanted, room["room"])
    if wanted <= 0:
        return rows.select("no", F.lit(0).cast("long").alias("seats"))

    def fewer(probes: list[int]) -> list[bool]:
        trial = F.explode(F.array(*[F.lit(_float(p)) for p in probes])).alias("d")
        counts = rows.select("w", "most", trial).groupBy("d").agg(F.sum(_above(F.col("d"))).alias("n")).collect()
        return [r["n"] < wanted for r in sorted(counts)]

    # Positive doubles are in the order of their bits. The last seat's quotient is the least number with fewer quotients above it.
    last = _float(_first(0, _bits(room["top"]), fewer))
    given = _above(F.lit(last))
    tied = (F.col("w") > 0) & (given < F.col("most")) & (F.col("w") / (2 * given + 1) == last)
    r = rows.agg(F.sum(given).alias("given"), F.max("no").alias("no")).first()
    left = wanted - r["given"]

    def enough(probes: list[int]) -> list[bool]:
        trial = F.explode(F.array(*[F.lit(p) for p in probes])).alias("p")
        counts = rows.select("no", tied.alias("tied"), trial).groupBy("p").agg(F.count_if(F.col("tied") & (F.col("no") <= F.col("p"))).alias("n")).collect()
        return [r["n"] >= left for r in sorted(counts)]

    upto = _first(-1, r["no"], enough)
    return rows.select("no", (given + F.when(tied & (F.col("no") <= upto), 1).otherwise(0)).alias("seats"))
