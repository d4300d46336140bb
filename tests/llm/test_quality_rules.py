"""The counts against a brute-force version, the verdict against the table, and that the plan stays in one task and in the JVM."""

import os
import re
from collections import Counter

import duckdb
import pytest

from lamina.llm import quality_rules, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def brute(text):
    words = WORDS.findall(text or "")
    n = len(words)
    found = Counter(tuple(words[i : i + 5]) for i in range(n - 4))
    inside = {i + k for i in range(n - 4) if found[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside), n < 10 or 100 * len(inside) > 20 * n


def shown(df):
    return sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in df.collect()), key=str)


PROSE = "the cat of this house was on the mat and it is for you that she has gone to see a bird with them"
TEXTS = [
    None, "", " ", "\n\n", "a", "a b c d", "a b c d e", "a b c d e f a b c d e", "a a a a a a", "a a a a a", "x\ty\vz\fw\rv\nu", "ab" * 50_000, PROSE,
    "\n".join([PROSE, "other words here", PROSE, "  ", PROSE]), "é ü 😀😀 #*$%&|<>   \u0085", "1 2 3 4 5 6 " * 400, f"{PROSE} | # $ * {PROSE}", "\x00 a \x1f b \x1c c",
]


def test_counts_match_brute_force(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (3, "a"), (None, "b b"), (None, None)]
    assert shown(quality_rules.quality_rules(docs(rows))) == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_random_texts(docs):
    import random

    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "dd ", "\n", "#x "][:m]) for _ in range(rng.randrange(120)))) for i, m in enumerate([2, 3, 4, 5, 6] * 40)]
    assert shown(quality_rules.quality_rules(docs(rows))) == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_equal_hashes_are_told_apart(spark):
    """Windows whose hashes agree are compared by their words."""
    from pyspark.sql import functions as F

    one = spark.createDataFrame([(["a", "b", "c", "d", "e", "f"],)], "words array<string>")
    assert one.select(quality_rules.repeated_words(F.col("words"), F.array(F.lit(7), F.lit(7)))).first()[0] == 0


@pytest.mark.parametrize(
    ("text", "failed"),
    [
        (PROSE, []),
        ("too few words", ["n_words"]),
        (PROSE + " " + PROSE, ["repeat_words_percent"]),
        (PROSE + " ### ***", ["symbols_per_word"]),
        (" ".join(f"w{i}x{i}" for i in range(60)), ["stop_word_share"]),
        (" ".join("abcdefghijklmnopqrst"), ["mean_word_length"]),
        ("\n".join(f"- the item{i} of{i} list{i}" for i in range(20)), ["bullet_line_share"]),
        ("\n".join(f"the item{i} of{i} list{i}..." for i in range(20)), ["ellipsis_line_share"]),
        ("\n".join(["the", PROSE[:40], "the", PROSE[40:]]), []),
        ("\n".join(["so so"] * 9 + [PROSE]), ["repeat_words_percent", "dup_line_share"]),
        (None, ["n_words", "mean_word_length"]),
    ],
)
def test_verdicts(docs, text, failed):
    r = quality_rules.quality_rules(docs([(1, text)])).first()
    assert (r.failed, r.kept, r.base_failed) == (failed, not failed, bool({"n_words", "repeat_words_percent"} & set(failed)))


def test_own_table_and_empty_input(docs):
    assert quality_rules.quality_rules(docs([(1, PROSE)]), [("n_words", 100, 200), ("symbols_per_word", None, 0)]).first().failed == ["n_words"]
    assert quality_rules.quality_rules(docs([(1, None)]), []).first().kept
    assert quality_rules.quality_rules(docs([])).count() == 0


def test_plan_is_native_and_has_no_exchange(docs):
    plan = quality_rules.quality_rules(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas|Udf|Generate|Sort ", plan)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_query_matches_sql(spark):
    df = queries.op13_quality_rules(spark, SF)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = duck.execute(queries.ORACLE_SQL["op13_quality_rules"])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want.fetchall())
