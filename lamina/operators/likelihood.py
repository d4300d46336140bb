"""Likelihoods of word vectors in long form under Dirichlet-multinomials, each as one aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions.dcm import digamma_rise, rising, type_prior

BETA = 0.1


def vocabulary_size(bow: DataFrame) -> DataFrame:
    """(docset, w): distinct terms of each docset."""
    return bow.groupBy("docset").agg(F.count_distinct("term").alias("w"))


def dcm(vectors: DataFrame, sizes: DataFrame, *keys: str, beta: float = BETA) -> DataFrame:
    """(keys, logp) of each vector of `vectors` (docset among the keys, term, cnt), with `sizes` (docset, w).

    lgamma(S) - lgamma(N + S) + sum [lgamma(c + beta) - lgamma(beta)], S = beta * w; zero counts add nothing.
    """
    totals = vectors.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.sum(rising(beta, F.col("cnt"))).alias("up"))
    return totals.join(sizes, "docset").select(*keys, (F.col("up") - rising(F.col("w") * beta, F.col("n"))).alias("logp"))


def dcm_gradient(vectors: DataFrame, sizes: DataFrame, *keys: str, beta: float = BETA) -> DataFrame:
    """(keys, gradient): d logp / d beta = sum [psi(c + beta) - psi(beta)] - w [psi(N + S) - psi(S)]."""
    totals = vectors.groupBy(*keys).agg(F.sum("cnt").alias("n"), F.sum(digamma_rise(beta, F.col("cnt"))).alias("up"))
    return totals.join(sizes, "docset").select(*keys, (F.col("up") - F.col("w") * digamma_rise(F.col("w") * beta, F.col("n"))).alias("gradient"))


def dcm_tallied(tallies: DataFrame, *keys: str, beta: float = BETA) -> DataFrame:
    """`dcm` of `bow.tallies`, which know w: `terms` terms have the count cnt."""
    totals = _tallied(tallies, rising(beta, F.col("cnt")), *keys)
    return totals.select(*keys, (F.col("up") - rising(F.col("w") * beta, F.col("n"))).alias("logp"))


def dcm_gradient_tallied(tallies: DataFrame, *keys: str, beta: float = BETA) -> DataFrame:
    """`dcm_gradient` of `bow.tallies`: see `dcm_tallied`."""
    totals = _tallied(tallies, digamma_rise(beta, F.col("cnt")), *keys)
    return totals.select(*keys, (F.col("up") - F.col("w") * digamma_rise(F.col("w") * beta, F.col("n"))).alias("gradient"))


def _tallied(tallies: DataFrame, up: Column, *keys: str) -> DataFrame:
    return tallies.groupBy(*keys, "w").agg(F.sum(F.col("cnt") * F.col("terms")).alias("n"), F.sum(up * F.col("terms")).alias("up"))


def topic_proportion(topics: DataFrame, *keys: str, prior: float = 1.0) -> DataFrame:
    """(keys, logp): a Dirichlet-multinomial over the sentences (`n_dish`) of the live topics of a scope; 0 without any."""
    live = topics.where("n_dish > 0").groupBy(*keys).agg(F.sum("n_dish").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(rising(prior, F.col("n_dish"))).alias("up"))
    return live.select(*keys, (F.col("up") - rising(F.col("k") * prior, F.col("n"))).alias("logp"))


def unigram(vectors: DataFrame, sizes: DataFrame, *keys: str, beta: float = BETA) -> DataFrame:
    """(keys, term, p): the smoothed unigram model (c + beta) / (beta w + N) of the terms that occur."""
    return vectors.join(sizes, "docset").withColumn("p", smoothed("cnt", *keys, beta=beta)).where("cnt > 0").select(*keys, "term", "p")


def smoothed(count: str, *keys: str, beta: float = BETA) -> Column:
    """p of `unigram` for rows (keys, term, w and the column `count`), by a window of the keys; null where the term doesn't occur."""
    return smoothed_by(F.col(count), F.col("w"), F.sum(count).over(Window.partitionBy(*keys)), beta)


def smoothed_by(count: Column, w: Column, n: Column, beta: float = BETA) -> Column:
    """p of `unigram` of a term with `count` of n words; null where the term doesn't occur."""
    return F.when(count > 0, (count + beta) / (beta * w + n))


def skewed_kl(left: DataFrame, right: DataFrame, *keys: str, skew: float = 0.99) -> DataFrame:
    """(keys, kl): sum over terms of r (ln r - ln(skew p + (1 - skew) r)), p of `left`, r of `right`; absent is 0."""
    return skewed_kl_of(right.withColumnRenamed("p", "r").join(left, [*keys, "term"], "left"), *keys, skew=skew)


def skewed_kl_of(both: DataFrame, *keys: str, skew: float = 0.99, terms: str | None = None) -> DataFrame:
    """`skewed_kl` of both models side by side (keys, p, r), null where a term is absent; a row is a term's, or those of as many as the column
    `terms` says."""
    both = both.where("r IS NOT NULL")
    mixed = skew * F.coalesce(F.col("p"), F.lit(0.0)) + (1 - skew) * F.col("r")
    part = F.col("r") * (F.log("r") - F.log(mixed))
    return both.groupBy(*keys).agg(F.sum(part * F.col(terms) if terms else part).alias("kl"))


def corpus_loglik(
    global_: DataFrame, local: DataFrame, type_counts: DataFrame, alpha: float, beta: float, proportions: Sequence[DataFrame] = (), word_priors: Sequence[float] = (BETA, BETA),
) -> DataFrame:
    """(docset, loglik): log-likelihoods of global topics (docset, logp), plus, for documents with local topics, those of
    `local` (docset, doc_id, logp) and the prior of their segment types (`type_counts`: docset, doc_id, x1, x2), plus the topic
    `proportions` (docset, logp) of global scopes and of documents. A word prior of 0 makes all of it impossible."""
    priors = type_counts.where("x2 > 0").select("docset", type_prior([F.col("x1"), F.col("x2")], [alpha, beta]).alias("logp"))
    parts = global_.select("docset", "logp").unionByName(local.select("docset", "logp")).unionByName(priors)
    for p in proportions:
        parts = parts.unionByName(p.select("docset", "logp"))
    return parts.groupBy("docset").agg(segment_logp(min(word_priors), F.sum("logp")).alias("loglik"))


def segment_logp(beta: float, logp: Column) -> Column:
    """A prior of 0 makes a segment impossible."""
    return F.lit(-1.7976931348623157e308) if beta == 0 else logp
