"""Scores of a segmentation and alignment against a gold standard, as DataFrame plans.

Labels are (docset, doc_id, pos, ref, hyp); negative labels (local topics) count as one label, -1, for boundaries. Clusters are
spans (docset, label, doc_id, start, end), both ends included. `clusters` is (docset, k): the number of gold clusters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DOC = ["docset", "doc_id"]


def _changes(label: str) -> Column:
    order = Window.partitionBy(*DOC).orderBy("pos")
    shown = F.greatest(F.col(label), F.lit(-1))
    return F.coalesce((shown != F.lag(shown).over(order)).cast("int"), F.lit(0))


def change_counts(labels: DataFrame) -> DataFrame:
    """`labels` with c_ref and c_hyp, the label changes up to a position; those between i and j are their difference."""
    so_far = Window.partitionBy(*DOC).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = labels.withColumn("d_ref", _changes("ref")).withColumn("d_hyp", _changes("hyp"))
    return marked.withColumn("c_ref", F.sum("d_ref").over(so_far)).withColumn("c_hyp", F.sum("d_hyp").over(so_far)).drop("d_ref", "d_hyp")


def document_scores(labels: DataFrame, clusters: DataFrame) -> DataFrame:
    """(docset, doc_id, n, pk, windowdiff, accuracy, length_ratio) of each document.

    Windows are k = n div (2 K) wide. A document is one row while its windows are compared: its lines as an array.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "c_ref", "c_hyp")))
    docs = change_counts(labels).groupBy(*DOC).agg(
        rows.alias("c"), F.count(F.lit(1)).alias("n"), F.avg((F.col("ref") == F.col("hyp")).cast("double")).alias("accuracy"),
        (F.max("c_hyp") + 1).alias("hyp_segments"), (F.max("c_ref") + 1).alias("ref_segments"),
    )
    docs = docs.join(clusters, "docset").withColumn("w", F.floor(F.col("n") / (2 * F.col("k"))).cast("int"))
    starts = F.sequence(F.lit(1), (F.col("n") - F.col("w")).cast("int"))
    within = lambda i, c: F.element_at("c", i + F.col("w"))[c] - F.element_at("c", i)[c]
    misses = lambda differ: F.size(F.filter(starts, lambda i: differ(within(i, "c_ref"), within(i, "c_hyp")))) / (F.col("n") - F.col("w"))
    return docs.select(
        *DOC, "n", misses(lambda r, h: (r != 0) != (h != 0)).alias("pk"), misses(lambda r, h: r != h).alias("windowdiff"), "accuracy",
        (F.col("hyp_segments") / F.col("ref_segments")).alias("length_ratio"),
    )


def spans(runs: DataFrame) -> DataFrame:
    """Clusters of the global topics of runs (docset, doc_id, seg, start, end, label), half-open there."""
    return runs.where("label >= 0").select("docset", F.col("label").cast("string").alias("label"), "doc_id", "start", (F.col("end") - 1).alias("end"))


def totals(clusters: DataFrame) -> DataFrame:
    """(docset, label, total): sentences of each cluster."""
    return clusters.groupBy("docset", "label").agg(F.sum(F.col("end") - F.col("start") + 1).alias("total"))


def overlaps(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(docset, ref, hyp, overlap): sentences that two clusters share. Spans meet sentence by sentence, so the work grows with a document's
    sentences and not with its pairs of spans."""
    each = lambda side, name: side.where("start <= end").select(*DOC, F.explode(F.sequence("start", "end")).alias("pos"), F.col("label").alias(name))
    return each(ref, "ref").join(each(hyp, "hyp"), [*DOC, "pos"]).groupBy("docset", "ref", "hyp").agg(F.count(F.lit(1)).alias("overlap"))


def best_matches(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(docset, ref, total, overlap, hyp_total): each gold cluster with the cluster that overlaps it most (the first by label
    of equals); zeros without any."""
    first = Window.partitionBy("docset", "ref").orderBy(F.desc("overlap"), "hyp")
    top = overlaps(ref, hyp).withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")
    top = top.join(totals(hyp).select("docset", F.col("label").alias("hyp"), F.col("total").alias("hyp_total")), ["docset", "hyp"])
    golds = totals(ref).withColumnRenamed("label", "ref")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return golds.join(top, ["docset", "ref"], "left").select("docset", "ref", "total", zero("overlap"), zero("hyp_total"))


def cluster_prf(ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(docset, precision, recall, f1): means over gold clusters, and F1 of the means (0 if either is)."""
    m = best_matches(ref, hyp)
    p = F.avg(F.when(F.col("overlap") > 0, F.col("overlap") / F.col("hyp_total")).otherwise(0.0))
    r = F.avg(F.when(F.col("overlap") > 0, F.col("overlap") / F.col("total")).otherwise(0.0))
    means = m.groupBy("docset").agg(p.alias("precision"), r.alias("recall"))
    return means.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def f1(p: Column, r: Column) -> Column:
    return F.when(p * r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def variation_of_information(ref: DataFrame, hyp: DataFrame, sizes: DataFrame) -> DataFrame:
    """(docset, norm_vi): 1 - (H(ref) + H(hyp) - 2 MI) / ln N over the N sentences of `sizes` (docset, n); null for N < 2."""
    entropy = lambda t: -F.sum(F.col(t) / F.col("n") * F.log(F.col(t) / F.col("n")))
    h_ref = totals(ref).join(sizes, "docset").groupBy("docset").agg(entropy("total").alias("h_ref"))
    h_hyp = totals(hyp).join(sizes, "docset").groupBy("docset").agg(entropy("total").alias("h_hyp"))
    met = overlaps(ref, hyp).join(totals(ref).withColumnsRenamed({"label": "ref", "total": "tr"}), ["docset", "ref"])
    met = met.join(totals(hyp).withColumnsRenamed({"label": "hyp", "total": "th"}), ["docset", "hyp"]).join(sizes, "docset")
    joint = F.col("overlap") / F.col("n")
    mi = met.groupBy("docset").agg(F.sum(joint * (F.log(joint) - F.log(F.col("tr") / F.col("n") * F.col("th") / F.col("n")))).alias("mi"))
    all_ = sizes.join(h_ref, "docset", "left").join(h_hyp, "docset", "left").join(mi, "docset", "left").fillna(0.0, ["h_ref", "h_hyp", "mi"])
    return all_.select("docset", F.when(F.col("n") > 1, 1 - (F.col("h_ref") + F.col("h_hyp") - 2 * F.col("mi")) / F.log("n")).alias("norm_vi"))


def rand_like(ref: DataFrame, hyp: DataFrame, sizes: DataFrame) -> DataFrame:
    """(docset, rand_like): 2 max(0, N (N - 1) / 2 - sum of best matches' sizes - sum of gold sizes) / (N (N - 1)); 0 for N < 2."""
    m = best_matches(ref, hyp).groupBy("docset").agg(F.sum(F.when(F.col("overlap") > 0, F.col("hyp_total")).otherwise(0)).alias("h"), F.sum("total").alias("r"))
    pairs = F.col("n") * (F.col("n") - 1)
    left = F.greatest(F.lit(0), F.floor(pairs / 2) - F.coalesce("h", F.lit(0)) - F.coalesce("r", F.lit(0)))
    return sizes.join(m, "docset", "left").select("docset", F.when(pairs > 0, 2.0 * left / pairs).otherwise(0.0).alias("rand_like"))


def rand_index(labels: DataFrame) -> DataFrame:
    """(docset, rand): the Rand index proper, the share of sentence pairs on which ref and hyp agree, from the contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cell = labels.groupBy("docset", "ref", "hyp").agg(F.count(F.lit(1)).alias("c"))
    both = cell.groupBy("docset").agg(pairs("c").alias("both"), F.sum("c").alias("n"))
    ref = cell.groupBy("docset", "ref").agg(F.sum("c").alias("c")).groupBy("docset").agg(pairs("c").alias("in_ref"))
    hyp = cell.groupBy("docset", "hyp").agg(F.sum("c").alias("c")).groupBy("docset").agg(pairs("c").alias("in_hyp"))
    all_ = both.join(ref, "docset").join(hyp, "docset")
    every = F.col("n") * (F.col("n") - 1) / 2
    return all_.select("docset", F.when(F.col("n") > 1, (every + 2 * F.col("both") - F.col("in_ref") - F.col("in_hyp")) / every).otherwise(1.0).alias("rand"))


def class_f1(labels: DataFrame, classes: int | None = None) -> DataFrame:
    """(docset, macro_f1, micro_f1) of labels as classes 0 .. classes - 1; labels outside are one further class that isn't scored.

    A class scores 2 correct / (guessed + true), 0 if it is neither. Macro: the mean over classes. Micro: weighted by true sizes. Without
    `classes`, each docset has as many as its largest label in `ref` or `hyp` asks for, one at least.
    """
    if classes is None:
        own = labels.groupBy("docset").agg(F.greatest(F.max("ref") + 1, F.max("hyp") + 1, F.lit(1)).alias("classes"))
        labels, classes = labels.join(own, "docset"), F.col("classes")
    else:
        labels, classes = labels.withColumn("classes", F.lit(classes)), F.col("classes")
    inside = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < classes), F.col(c)).otherwise(classes)
    sided = labels.select("docset", "classes", F.explode(F.array(F.struct(inside("ref").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("g")), F.struct(inside("hyp").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("g")))).alias("x"),
                          (inside("ref") == inside("hyp")).cast("int").alias("hit"))
    by_class = sided.where(F.col("x.class") < classes).groupBy("docset", "classes", F.col("x.class").alias("class")).agg(
        F.sum("x.t").alias("t"), F.sum("x.g").alias("g"), F.sum(F.col("hit") * F.col("x.t")).alias("c")
    )
    return by_class.groupBy("docset").agg(
        (F.sum(2.0 * F.col("c") / (F.col("t") + F.col("g"))) / F.max("classes")).alias("macro_f1"),
        F.coalesce(F.sum(2.0 * F.col("c") / (F.col("t") + F.col("g")) * F.col("t")) / F.nullif(F.sum("t"), F.lit(0)), F.lit(0.0)).alias("micro_f1"),
    )


def corpus_scores(labels: DataFrame, clusters: DataFrame, ref: DataFrame, hyp: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row: means over documents of accuracy, pk, windowdiff and length_ratio; means over docsets of precision, recall, norm_vi
    and rand_like; and F1 of those means."""
    by_doc = document_scores(labels, clusters).agg(*[F.avg(c).alias(c) for c in ("accuracy", "pk", "windowdiff", "length_ratio")])
    by_set = cluster_prf(ref, hyp).join(variation_of_information(ref, hyp, sizes), "docset").join(rand_like(ref, hyp, sizes), "docset")
    by_set = by_set.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "norm_vi", "rand_like")])
    one = by_doc.unionByName(by_set, allowMissingColumns=True)
    return one.agg(*[F.max(c).alias(c) for c in one.columns]).withColumn("f1", f1(F.col("precision"), F.col("recall")))


def report_lines(labels: DataFrame, clusters: DataFrame, ref: DataFrame, hyp: DataFrame, sizes: DataFrame) -> DataFrame:
    """(docset, line): the report of each docset, its documents' scores averaged."""
    docs = document_scores(labels, clusters).groupBy("docset").agg(*[F.avg(c).alias(c) for c in ("accuracy", "pk", "windowdiff", "length_ratio")])
    sets = cluster_prf(ref, hyp).join(variation_of_information(ref, hyp, sizes), "docset").join(rand_like(ref, hyp, sizes), "docset")
    shape = "docName=%s\t" + "\t".join(f"{n}=%.4f" for n in ("P", "R", "F1", "VI", "RI", "Pk", "WD")) + "\tlen=%.2f\tacc=%.4f"
    names = ("precision", "recall", "f1", "norm_vi", "rand_like", "pk", "windowdiff", "length_ratio", "accuracy")
    # Halves are rounded up here, whatever a double makes of them.
    half_up = [F.floor(F.col(c) * 10**n + 0.500000001) / 10**n for c, n in zip(names, [4] * 7 + [2, 4], strict=True)]
    return docs.join(sets, "docset").select("docset", F.format_string(shape, "docset", *half_up).alias("line"))


def by_document(clusters: DataFrame) -> DataFrame:
    """Clusters restricted to single documents, which become the sets: docset is `docset#doc_id`."""
    return clusters.withColumn("docset", F.concat_ws("#", "docset", F.col("doc_id").cast("string")))


def document_cluster_scores(labels: DataFrame, ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(docset, doc_id, precision, recall, f1, norm_vi, rand_like) of each document on its own."""
    r, h = by_document(ref), by_document(hyp)
    n = labels.groupBy(*DOC).agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.concat_ws("#", "docset", F.col("doc_id").cast("string")))
    sizes = n.select(F.col("key").alias("docset"), "n")
    scores = cluster_prf(r, h).join(variation_of_information(r, h, sizes), "docset").join(rand_like(r, h, sizes), "docset")
    return n.select(*DOC, "key").join(scores.withColumnRenamed("docset", "key"), "key").drop("key")


def document_report_lines(labels: DataFrame, clusters: DataFrame, ref: DataFrame, hyp: DataFrame) -> DataFrame:
    """(docset, doc_id, line): the report of each document."""
    rows = document_scores(labels, clusters).join(document_cluster_scores(labels, ref, hyp), DOC)
    shape = "docName=%s\tdocid=%d\t" + "\t".join(f"{n}=%.4f" for n in ("P", "R", "F1", "VI", "RI", "Pk", "WD")) + "\tlen=%.2f\tacc=%.4f"
    names = ("precision", "recall", "f1", "norm_vi", "rand_like", "pk", "windowdiff", "length_ratio", "accuracy")
    half_up = [F.floor(F.coalesce(F.col(c), F.lit(0.0)) * 10**n + 0.500000001) / 10**n for c, n in zip(names, [4] * 7 + [2, 4], strict=True)]
    return rows.select(*DOC, F.format_string(shape, "docset", "doc_id", *half_up).alias("line"))
