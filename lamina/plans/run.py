"""A whole experiment from a configuration: read a corpus, segment and align it, score it, export it.

    python -m lamina.plans.run -c experiment.cfg
"""

from __future__ import annotations

import argparse
import contextlib
import logging
import time
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.stemmer import with_stems
from lamina.operators import bow, dp, kmeans, likelihood, metrics, sampler, segments, topics
from lamina.session import materialize, ship
from lamina.sources import corpus, sinks

log = logging.getLogger("lamina")
DOC = ["docset", "doc_id"]


def model_of(name: str) -> str:
    """The model that a class name or a short name stands for: sampler, alignment of single segmentations, or sentence k-means."""
    last = name.rsplit(".", 1)[-1].lower()
    for part, model in (("kmean", "kmeans"), ("single", "single"), ("multi", "multi")):
        if part in last:
            return model
    raise ValueError(f"unknown model {name!r}")


def flag(config: dict[str, str], key: str, default: bool = False) -> bool:
    return config.get(key, str(default)).strip().lower() == "true"


def settings_of(config: dict[str, str]) -> sampler.Settings:
    number = lambda key, default: float(config.get(key, default))
    return sampler.Settings(
        beta_global=number("prior.dcm.global", 0.1), beta_local=number("prior.dcm.local", 0.1), topic_prior=number("prior.tp.global", 1), use_topic_prior=flag(config, "prior.useTopicProp"),
        concentration=number("prior.dp", 0.1), type_alpha=number("prior.docset.globalType", 1), type_beta=number("prior.docset.localType", 1),
        max_global=int(number("sampler.maxGlobalCluster", 0)), start_global=int(number("sampler.minGlobalCluster", 1)), global_merge=flag(config, "sampler.globalMerge", True),
        local_swap=flag(config, "sampler.localSwap"), aggressive=flag(config, "sampler.localAggressive"), iterations=int(number("sampler.maxMcmcIter", 100_000)), warm_up=int(number("sampler.initGlobal", 10_000)),
        max_shift=int(number("sampler.maxShiftMove", 20)), max_split=int(number("sampler.maxSplitMove", 20)), burn_in=number("rand.burninDuration", 0.25), cooling=number("rand.coolingDuration", 0.25),
        hottest=number("rand.maxBurninTemp", 5), trace_every=int(number("sampler.printPeriod", 1000)), seed=int(number("rand.seed", 0)), symmetric=flag(config, "sampler.symmetric", True),
    )


def document_priors(config: dict[str, str], base: sampler.Settings) -> dict[int, tuple[float, float]]:
    """(alpha, beta) by document id from `prior.doc.<n>.globalType` and `.localType`."""
    out: dict[int, list[float]] = {}
    for key, value in corpus.with_prefix(config, "prior.doc.").items():
        n, _, kind = key.removeprefix("prior.doc.").partition(".")
        pair = out.setdefault(int(n), [base.type_alpha, base.type_beta])
        if kind in ("globalType", "localType"):
            pair[kind == "localType"] = float(value)
    return {n: (a, b) for n, (a, b) in out.items()}


def words_of(spark: SparkSession, lines: DataFrame, config: dict[str, str]) -> DataFrame:
    tokens = bow.tokens(lines, tokenizer=flag(config, "corpus.useTokenizer"))
    stem = flag(config, "corpus.useStemmer")
    if stem:
        tokens = with_stems(tokens).drop("term").withColumnRenamed("stem", "term")
    if flag(config, "corpus.removeStopword") and config.get("corpus.stopwordList"):
        tokens = bow.without_stop_words(tokens, corpus.read_stop_words(spark, config["corpus.stopwordList"], stem))
    return materialize(bow.counts(tokens), "run-bow")


@dataclass
class Gold:
    """What results are compared with."""

    lines: DataFrame
    labels: DataFrame
    spans: DataFrame
    clusters: DataFrame

    def against(self, found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """What `metrics` asks for: labels of both, the number of gold clusters, clusters of both, sizes."""
        both = self.labels.withColumnRenamed("label", "ref").join(found.withColumnRenamed("label", "hyp"), [*DOC, "pos"])
        both = both.withColumns({"ref": F.greatest("ref", F.lit(-1)), "hyp": F.greatest("hyp", F.lit(-1))})
        n = both.groupBy("docset").agg(F.count(F.lit(1)).alias("n"))
        return both, self.clusters, self.spans, metrics.spans(segments.runs(found)), n


def progress_line(states: DataFrame, gold: Gold, since: float) -> str:
    """The sampler's state after a round: log-likelihood over all docsets, shares of moves accepted, scores against the gold standard, seconds."""
    last = F.element_at("trace", -1)
    shares = [F.avg(last[f"accepted_{k}"]).alias(k) for k in sampler.KINDS]
    now = states.agg(F.max("iter").alias("iter"), F.sum(last["loglik"]).alias("loglik"), *shares).first()
    scores = metrics.corpus_scores(*gold.against(sampler.labels_of(states).drop("trial", "iter"))).first()
    moves = " ".join(f"{k}={100 * (now[k] or 0):.1f}%" for k in sampler.KINDS)
    parts = zip(("P", "R", "F1", "Pk", "WD"), ("precision", "recall", "f1", "pk", "windowdiff"), strict=True)
    return f"iter={now['iter']} loglik={now['loglik'] or 0:.2f} {moves} " + " ".join(f"{k}={scores[c] or 0:.4f}" for k, c in parts) + f" seconds={time.monotonic() - since:.1f}"


@contextlib.contextmanager
def log_sinks(config: dict[str, str]) -> Iterator[None]:
    """Where the driver's log lines go meanwhile: to the console unless `exp.console` is false, and on to the end of the file `exp.log`."""
    sinks_: list[logging.Handler] = [logging.StreamHandler()] if flag(config, "exp.console", True) else []
    if config.get("exp.log"):
        sinks_.append(logging.FileHandler(config["exp.log"], encoding="utf-8"))
        sinks_[-1].setFormatter(logging.Formatter("[%(asctime)s] %(levelname)s %(message)s"))
    level, through = log.level, log.propagate
    log.setLevel(logging.INFO)
    log.propagate = False
    for s in sinks_:
        log.addHandler(s)
    try:
        yield
    finally:
        log.setLevel(level)
        log.propagate = through
        for s in sinks_:
            log.removeHandler(s)
            s.close()


def segment(spark: SparkSession, config: dict[str, str], lines: DataFrame, words: DataFrame, gold: Gold, trial: int) -> DataFrame:
    """(docset, doc_id, pos, label) by the configured model. Gold numbers of clusters are used where there are any. The sampler's rounds
    are its print periods; each ends with a `progress_line`."""
    clusters = gold.clusters
    sizes = segments.lengths(lines)
    w = likelihood.vocabulary_size(words)
    if flag(config, "model.sharedDict"):
        w = w.select("docset", F.lit(words.agg(F.count_distinct("term")).first()[0]).cast("long").alias("w"))
    w = sizes.select("docset").distinct().join(w, "docset", "left").fillna(1, ["w"])
    base = settings_of(config)
    model = model_of(config.get("model.class", "multi"))
    if model == "multi":
        caps = {k.removeprefix("sampler.docset.maxGlobalCluster."): int(v) for k, v in corpus.with_prefix(config, "sampler.docset.maxGlobalCluster.").items()}
        starts = clusters if flag(config, "sampler.initUniform") else None
        since = time.monotonic()
        told = lambda states: log.info("trial %d: %s", trial, progress_line(states, gold, since))
        base = replace(base, round=base.trace_every)
        return sampler.assignments(words, sizes, w, base, [trial], starts, after=told, priors=document_priors(config, base), caps=caps).drop("trial")
    default = sizes.groupBy("docset").agg(F.max(segments.default_k(F.col("n"))).alias("d"))
    k_set = default.join(clusters, "docset", "left").select("docset", F.coalesce("k", "d").cast("int").alias("k"))
    vectors = bow.tf_idf(words)
    if model == "single":
        own = gold.labels.groupBy(*DOC).agg(F.count_distinct("label").alias("own"))
        k = sizes.join(own, DOC, "left").select(*DOC, "n", F.coalesce("own", segments.default_k(F.col("n"))).cast("int").alias("want"))
        pieces = dp.segment(lines, words, k, w, F.col("want"), base.beta_global)
    else:
        longest = sizes.groupBy("docset").agg(F.max("n").alias("longest"))
        k_set = k_set.join(longest, "docset").select("docset", F.least("k", "longest").cast("int").alias("k"))
        pieces = sizes.select(*DOC, F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start")).withColumn("end", F.col("start") + 1)
    labelled = kmeans.align(pieces, vectors, k_set, seed=base.seed + trial)
    return labelled.select(*DOC, F.explode(F.expr("sequence(start, end - 1)")).alias("pos"), "label")


def run(spark: SparkSession, config: dict[str, str]) -> DataFrame | None:
    """Run every trial; returns (trial, docset, line), the reports, or None without a dataset folder."""
    folder = config.get("corpus.datasetDir")
    if not folder:
        return None
    with log_sinks(config):
        return _trials(ship(spark), config, folder)


def _trials(spark: SparkSession, config: dict[str, str], folder: str) -> DataFrame:
    lines = materialize(corpus.read_documents(spark, folder), "run-lines")
    labels = corpus.read_labels(spark, folder)
    inside = corpus.check_spans(labels, lines).where("inside").drop("inside")
    gold = Gold(lines, corpus.gold_labels(labels, lines), inside, labels.groupBy("docset").agg(F.count_distinct("label").alias("k")))
    words = words_of(spark, lines, config)
    reports = None
    for trial in range(1, int(config.get("exp.trial", 1)) + 1):
        found = materialize(segment(spark, config, lines, words, gold, trial), "run-labels")
        sides = gold.against(found)
        if flag(config, "exp.perDocEval"):
            rows = metrics.document_report_lines(*sides[:4]).select("docset", "line")
        else:
            rows = metrics.report_lines(*sides)
        rows = rows.select(F.lit(trial).alias("trial"), "docset", "line")
        reports = rows if reports is None else reports.unionByName(rows)
        log.info("trial %d: %s", trial, metrics.corpus_scores(*sides).first())
        if config.get("output.outputDir"):
            out = config["output.outputDir"] + f"/trial-{trial}"
            sinks.write_segmented(lines, found, f"{out}/segments")
            words_by_topic = topics.distinctive_words(topics.topic_vectors(words, found))
            sinks.write_lines(sinks.topic_word_lines(words_by_topic), f"{out}/topic-words")
    reports = materialize(reports, "run-reports")
    if config.get("exp.output"):
        sinks.write_lines(reports, config["exp.output"], "line")
    return reports


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("-c", "--config", required=True)
    spark = SparkSession.builder.getOrCreate()
    run(spark, corpus.read_config(spark, parser.parse_args().config)).show(truncate=False)


if __name__ == "__main__":
    main()
