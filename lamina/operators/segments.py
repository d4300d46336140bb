"""Segments of documents as labels by position: uniform cuts, runs, the best single cut, proposals of moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.dcm import lgamma_whole, rising

DOC = ["docset", "doc_id"]


def default_k(n) -> Column:
    """Segments of a document of n sentences where no gold standard says: one for every five, at least one."""
    return F.least(n, F.greatest(F.lit(1), F.ceil(n / 5))).cast("int")


def lengths(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*DOC).agg((F.max("pos") + 1).alias("n"))


def uniform(sizes: DataFrame, k: Column) -> DataFrame:
    """(docset, doc_id, pos, label): `sizes` (docset, doc_id, n) cut before round(j n / k), j = 1 .. k - 1, halves up."""
    rows = sizes.withColumn("k", k).withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(*DOC, "pos", uniform_label(F.col("pos"), F.col("n"), F.col("k")).alias("label"))


def uniform_label(pos, n, k) -> Column:
    """The label of a sentence in `uniform`: how many j have round(j n / k) <= pos, that is 2 j n < (2 pos + 1) k, in whole numbers."""
    parts = F.least(n, F.greatest(F.lit(1), k)).cast("long")
    return F.floor(((2 * pos.cast("long") + 1) * parts - 1) / (2 * n.cast("long"))).cast("int")


def uniform_runs(sizes: DataFrame, k: Column) -> DataFrame:
    """`runs` of `uniform`, without making the labels: segment j begins at round(j n / k), halves up."""
    rows = sizes.withColumn("k", F.least("n", F.greatest(F.lit(1), k)).cast("long"))
    cut = lambda j: F.floor((2 * j.cast("long") * F.col("n") + F.col("k")) / (2 * F.col("k"))).cast("int")
    rows = rows.withColumn("seg", F.explode(F.sequence(F.lit(0), (F.col("k") - 1).cast("int"))))
    return rows.select(*DOC, "seg", cut(F.col("seg")).alias("start"), cut(F.col("seg") + 1).alias("end"), F.col("seg").alias("label"))


def runs(labels: DataFrame) -> DataFrame:
    """(docset, doc_id, seg, start, end, label): maximal runs of equal labels, half-open."""
    order = Window.partitionBy(*DOC).orderBy("pos")
    change = F.coalesce((F.col("label") != F.lag("label").over(order)).cast("int"), F.lit(0))
    marked = labels.withColumn("change", change)
    marked = marked.withColumn("seg", F.sum("change").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*DOC, "seg", "label").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")).select(*DOC, "seg", "start", "end", "label")


def best_cut(bow: DataFrame, sizes: DataFrame, vocab: DataFrame, beta: float = 0.1) -> DataFrame:
    """(docset, doc_id, cut, logp): the cut into two segments with the highest sum of Dirichlet-multinomial log-likelihoods, the
    latest of equals, for documents of two sentences or more (`sizes`: docset, doc_id, n; `vocab`: docset, w).

    A term's count left of a cut is a prefix sum, known wherever the term occurs; scores change there only. So each occurrence
    contributes the change of the term's part of the score to all later cuts, and a running sum gives the score of every cut:
    linear in the occurrences, where comparing all cuts with all terms would be quadratic.
    """
    by_term = Window.partitionBy(*DOC, "term")
    upto = F.sum("cnt").over(by_term.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    parts = bow.withColumn("all", F.sum("cnt").over(by_term)).withColumn("left", upto).withColumn("terms", F.lit(1))
    steps = parts.groupBy(*DOC, "pos").agg(*_changes(beta))
    cuts = sizes.where("n > 1").withColumn("pos", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return _best(cuts.join(steps, [*DOC, "pos"], "left").join(vocab, "docset"), beta)


def best_cut_tallied(tallies: DataFrame, beta: float = 0.1) -> DataFrame:
    """`best_cut` of `bow.tallies` by line, which know w, the terms' counts up to and including the line (`left`) and in the document (`all`),
    and have each line."""
    return _best(tallies.where("n > 1 AND w > 0").groupBy(*DOC, "n", "w", "pos").agg(*_changes(beta)), beta)


def _changes(beta: float) -> list[Column]:
    """Of the entries (cnt, left, all) of `terms` terms each: what their line changes for later cuts, words, and scores of whole terms."""
    score = lambda left: rising(beta, left) + rising(beta, F.col("all") - left)
    delta = score(F.col("left")) - score(F.col("left") - F.col("cnt"))
    whole = F.when(F.col("left") == F.col("cnt"), rising(beta, F.col("all"))).otherwise(0.0)
    return [F.sum(x * F.col("terms")).alias(name) for x, name in ((delta, "delta"), (F.col("cnt"), "words"), (whole, "whole"))]


def _best(steps: DataFrame, beta: float) -> DataFrame:
    """The best cut of each document from the changes of its lines (docset, doc_id, n, w, pos, delta, words, whole)."""
    doc = Window.partitionBy(*DOC)
    so_far = doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    n_left = F.coalesce(F.sum("words").over(so_far), F.lit(0))
    n_all = F.coalesce(F.sum("words").over(doc), F.lit(0))
    up = F.coalesce(F.sum("delta").over(so_far), F.lit(0.0)) + F.coalesce(F.sum("whole").over(doc), F.lit(0.0))
    s = F.col("w") * beta
    steps = steps.select(*DOC, (F.col("pos") + 1).alias("cut"), "n", n_left.alias("n_left"), n_all.alias("n_all"), up.alias("up"), s.alias("s"))
    scored = steps.where("cut < n").withColumn("logp", F.col("up") - rising(F.col("s"), F.col("n_left")) - rising(F.col("s"), F.col("n_all") - F.col("n_left")))
    best = F.max(F.struct(F.round("logp", 6).alias("r"), "cut", "logp"))
    return scored.groupBy(*DOC).agg(best.alias("b")).select(*DOC, F.col("b.cut").alias("cut"), F.col("b.logp").alias("logp"))


def step_weights(most: int) -> Column:
    """For moves of a boundary by -most .. most: i ** (-1 / sqrt(most)), nothing for 0, normalised; as an array."""
    raw = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda i: F.when(i == 0, 0.0).otherwise(F.pow(F.abs(i).cast("double"), F.lit(-1.0 / most**0.5))))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda s, y: s + y))


def truncated_steps(low, high, most: int) -> Column:
    """The proposals for a boundary that may move by low .. high: an array of (step, weight), `step_weights` cut off there and normalised anew."""
    steps = F.sequence(F.greatest(low, F.lit(-most)), F.least(high, F.lit(most)))
    raw = F.transform(steps, lambda i: F.struct(i.alias("step"), F.when(i == 0, 0.0).otherwise(F.pow(F.abs(i).cast("double"), F.lit(-1.0 / most**0.5))).alias("w")))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda s, y: s + y["w"])
    return F.transform(raw, lambda x: F.struct(x["step"].alias("step"), F.when(total(raw) > 0, x["w"] / total(raw)).otherwise(0.0).alias("weight")))


def dp_ratio(move: str, alpha: float, n1, n2, n1_new=None, n2_new=None) -> Column:
    """Log ratio of the partition prior for a split into n1 and n2, the merge of them, or a swap to n1_new and n2_new."""
    g = lambda n: lgamma_whole(F.greatest(n - 1, F.lit(0)))
    apart = F.log(F.lit(alpha)) + g(n1) + g(n2) - g(n1 + n2)
    return {"split": lambda: apart, "merge": lambda: -apart, "swap": lambda: g(n1_new) + g(n2_new) - g(n1) - g(n2)}[move]()


def proposal_ratio(move: str, n1, n2) -> Column:
    """Log ratio of the ways to propose the reverse of a move: a split is one of 2 ** (n - 2) ways to part n sentences."""
    ways = (n1 + n2 - 2) * F.log(F.lit(2.0))
    return {"split": ways, "merge": -ways, "swap": F.lit(0.0)}[move]
