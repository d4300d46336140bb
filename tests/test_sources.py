"""Readers and writers on files made here."""

from pyspark.sql import functions as F

from lamina.operators import bow, segments
from lamina.sources import corpus, sinks


def make(tmp_path):
    (tmp_path / "A_b.0").write_text("one.\ntwo\n\nfour\n")
    (tmp_path / "A_b.1").write_text("x\r\ny")
    (tmp_path / "A_b.3").write_text("gap")
    (tmp_path / "C.0.1").write_text("set C.0 has no document 0")
    (tmp_path / "D.1").write_text("no document 0")
    (tmp_path / "A_b.label").write_text("A 0::0-1 1::0-0\n2 0::3-3 3::5-6\n\n")
    return str(tmp_path)


def test_corpus(spark, tmp_path):
    folder = make(tmp_path)
    lines = corpus.read_documents(spark, folder)
    got = sorted((r["docset"], r["doc_id"], r["pos"], r["line"]) for r in lines.collect())
    assert got == [("A_b", 0, 0, "one."), ("A_b", 0, 1, "two"), ("A_b", 0, 2, ""), ("A_b", 0, 3, "four"), ("A_b", 1, 0, "x"), ("A_b", 1, 1, "y"), ("A_b", 3, 0, "gap")]
    labels = corpus.read_labels(spark, folder)
    assert sorted((r["label"], r["doc_id"], r["start"], r["end"]) for r in labels.collect()) == [("2", 0, 3, 3), ("2", 3, 5, 6), ("A", 0, 0, 1), ("A", 1, 0, 0)]
    assert {(r["doc_id"], r["inside"]) for r in corpus.check_spans(labels, lines).collect()} == {(0, True), (1, True), (3, False)}
    gold = {(r["doc_id"], r["pos"]): r["label"] for r in corpus.gold_labels(labels, lines).collect()}
    assert gold == {(0, 0): 1, (0, 1): 1, (0, 2): -1, (0, 3): 0, (1, 0): 1, (1, 1): -1, (3, 0): -1}


def test_stop_words(spark, tmp_path):
    path = tmp_path / "stop.list"
    path.write_text("skipped\nThe \nrunning\n\nthe\n")
    assert {r["term"] for r in corpus.read_stop_words(spark, str(path)).collect()} == {"the", "running"}
    assert {r["term"] for r in corpus.read_stop_words(spark, str(path), stemmed=True, skip_first=False).collect()} == {"the", "run", "skip"}


def test_config(spark, tmp_path):
    path = tmp_path / "c.cfg"
    path.write_text("a.b = 1\na.b=2\na.c\t3 4\nshort\n\nprior.doc.0.x = 5\n")
    config = corpus.read_config(spark, str(path))
    assert config == {"a.b": "1", "a.c": "3", "prior.doc.0.x": "5"}
    assert corpus.with_prefix(config, "prior.doc.") == {"prior.doc.0.x": "5"}


def test_writers(spark, tmp_path):
    lines = spark.createDataFrame([("s", 0, 0, "a"), ("s", 0, 1, "b")], "docset string, doc_id long, pos int, line string")
    labels = spark.createDataFrame([("s", 0, 0, 0), ("s", 0, 1, 1)], "docset string, doc_id long, pos int, label int")
    sinks.write_segmented(lines, labels, str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out/docset=s/doc_id=0").glob("*.txt")] == ["===== 0\na\n===== 1\nb\n=====\n"]
    words = spark.createDataFrame([("s", 0, 1, "a", 0.5), ("s", 0, 2, "b", 0.25)], "docset string, topic int, rank int, term string, score double")
    listing = sinks.topic_word_lines(words)
    assert listing.first()["value"] == "TOPIC 0\na 0.5\nb 0.25\n"
    sinks.write_lines(listing, str(tmp_path / "words"))


def test_corpus_round_trip(spark, tmp_path):
    rows = [("a b/c+%.1", 0, 0, "one"), ("a b/c+%.1", 0, 1, ""), ("a b/c+%.1", 2, 0, "\u00e9 two"), ("z", 0, 0, "")]
    lines = spark.createDataFrame(rows, "docset string, doc_id long, pos int, line string")
    spans = spark.createDataFrame([("z", "1", 0, 0, 0), ("a b/c+%.1", "x", 2, 0, 0), ("a b/c+%.1", "x", 0, 0, 1)], "docset string, label string, doc_id long, start int, end int")
    folder = f"file:{tmp_path}/made/corpus"
    assert sinks.write_files(sinks.document_files(lines), folder) == 3 and sinks.write_files(sinks.label_files(spans), folder) == 2
    assert sinks.write_files(sinks.document_files(lines.limit(0)), folder) == 0
    name = F.url_decode("docset")
    got = corpus.read_documents(spark, folder).select(name, "doc_id", "pos", "line")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    back = corpus.read_labels(spark, folder).select(name, "label", "doc_id", "start", "end")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, spans.collect()))


def test_only_documents_0_say_which_sets_are_read(spark, tmp_path):
    """What sets there are is looked up in the files of documents 0; no other file is opened for that."""
    for name in ("a.0", "a.1", "a.2", "a.3", "b.00", "b.5", "c.01", "c.2", "d.1"):
        (tmp_path / name).write_text(f"{name}\n")
    docs = corpus.read_documents(spark, str(tmp_path))
    assert sorted((r["docset"], r["doc_id"], r["line"]) for r in docs.collect()) == [("a", 0, "a.0"), ("a", 1, "a.1"), ("a", 2, "a.2"), ("a", 3, "a.3"), ("b", 0, "b.00"), ("b", 5, "b.5")]
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    assert sorted(len(leaves.apply(i).relation().location().inputFiles()) for i in range(leaves.size())) == [3, 9]


def test_files_of_whole_texts(spark):
    """As of their lines, for shared ids, closing line ends and null texts too."""
    texts = [(1, "b\na"), (1, "c\nd\ne\n"), (2, "x\n\n"), (3, ""), (4, None), (5, "one"), (6, "\n"), (6, None)]
    docs = spark.createDataFrame([(i, t, "s/é") for i, t in texts], "doc_id long, text string, source string")
    want = sinks.document_files(bow.lines(docs)).collect()
    assert sorted(map(tuple, sinks.text_files(bow.by_docset(docs)).collect())) == sorted(map(tuple, want)) and len(want) == 5


def test_small_files_share_tasks(spark, tmp_path):
    """With Spark's own cost of opening a file a task got some 30 of them."""
    for i in range(400):
        (tmp_path / f"s%2F.{i}").write_text(f"text {i}\n")
    (tmp_path / "s%2F.label").write_text("0 1::0-0\r\n1 2::0-0 3::0-0")
    (tmp_path / "other.txt").write_text("x")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    files = corpus.read_files(spark, str(tmp_path))
    assert files.count() == 401 and len(files.inputFiles()) <= spark.sparkContext.defaultParallelism + 1
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert {(r["docset"], r["doc_id"], r["value"]) for r in corpus.documents_of(files).collect()} == {("s%2F", i, f"text {i}") for i in range(400)}
    assert sorted((r["label"], r["doc_id"]) for r in corpus.labels_of(files).collect()) == [("0", 1), ("1", 2), ("1", 3)]


def test_labelled_lines(spark, tmp_path):
    """Whole documents give the labels and counts that joins of lines give."""
    folder = make(tmp_path)
    (tmp_path / "A_b.2").write_text("a, b\nc--d\ne\nf\n\n")
    (tmp_path / "A_b.label").write_text("10 2::1-1 2::3-9\n2 2::1-2 0::0-1 7::0-0\n")
    lines, labels = corpus.read_documents(spark, folder), corpus.read_labels(spark, folder)
    keys, stop = ["docset", "doc_id", "pos"], [",", "d"]
    kept = bow.tokens(lines, stop=stop).groupBy(*keys).count()
    want = lines.join(corpus.gold_labels(labels, lines), keys).join(kept, keys, "left").fillna(0, ["count"]).select(*keys, "line", "label", "count")
    got = corpus.labelled_lines(corpus.documents_of(corpus.read_files(spark, folder)), labels, stop)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_uniform_runs(spark):
    sizes = spark.createDataFrame([("s", n, n) for n in range(1, 40)], "docset string, doc_id long, n int")
    for k in (F.lit(1), F.lit(7), F.col("n"), F.col("n") + 3, F.ceil(F.col("n") / 5)):
        got, want = segments.uniform_runs(sizes, k), segments.runs(segments.uniform(sizes, k))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
