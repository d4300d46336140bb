"""Quality rules: a table of thresholds, compiled into one projection of length, symbol, stop-word, line and repetition ratios.

DataFrame functions only; a row's work is linear in its text (but for sorting the windows of texts that repeat some) and no row leaves
its task: the plan has no exchange, no Python and no user function.

Words are maximal runs of characters that aren't ASCII white space. A text's windows are its stretches of five words. They are compared
by 64-bit hashes first; only where two hashes of a text agree are the words themselves compared, so results are exact.

Defined edge cases: a null text has no words and no lines, so fails by length; an empty text has one line without words. Rows with null or
shared ids and repeated rows are judged one by one. An empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: What counts as a symbol.
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = """
the of and to a in is that it for was on with be as this by are at from or an not have has he she they we you his her their which but
de la le et les des en un du que une est pour qui dans par au pas sur avec ce il elle nous vous se son sa ses plus ou mais
der die und den von zu das mit sich des für auf im nicht ist dem eine ein als auch es an er sie ich wir ihr bei nach wie war hat oder
el los del las por con no para su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me y
""".split()

#: (ratio, least, most); None is no limit. Ratios are columns of `ratios`.
Threshold = tuple[str, float | None, float | None]
THRESHOLDS: list[Threshold] = [
    ("n_words", 10, None),
    ("repeat_words_percent", None, 20),
    ("mean_word_length", 2.5, 12),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.01, None),
    ("dup_line_share", None, 0.5),
    ("bullet_line_share", None, 0.9),
    ("ellipsis_line_share", None, 0.5),
]
#: The part of the table that makes `base_failed`.
BASE = ("n_words", "repeat_words_percent")
#: Texts with fewer words are too short for a share of stop words to tell anything.
STOP_WORDS_FROM = 50


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once for a row, however often it is used there."""
    return F.transform(F.array(value), body)[0]


def _neighbours_equal(sorted_: Column, key: str) -> Column:
    """The elements of a sorted array of structs whose `key` is also that of the one before or after."""
    same = lambda x, i: F.coalesce(x[key] == F.get(sorted_, i)[key], F.lit(False))
    return F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1))


def repeated_words(words: Column, hashes: Column) -> Column:
    """How many of `words` lie in windows that occur twice or more; `hashes` are those of `windows`."""
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    text_at = lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(WINDOW)])
    by_text = lambda found: F.sort_array(F.transform(found, lambda x: F.struct(text_at(x["i"]).alias("t"), x["i"].alias("i"))))
    exact = _let(_let(by_hash, lambda s: _neighbours_equal(s, "h")), lambda found: _let(by_text(found), lambda s: _neighbours_equal(s, "t")))
    starts = F.sort_array(F.transform(exact, lambda x: x["i"]))
    gaps = lambda s: F.zip_with(s, F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
    covered = _let(starts, lambda s: F.aggregate(gaps(s), F.lit(0), lambda n, x: n + x))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0)


def windows(words: Column) -> Column:
    """A hash of each window of `words`, in order."""
    at = F.sequence(F.lit(0), F.size(words) - WINDOW)
    of = lambda h: F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, _let(F.transform(words, lambda w: F.xxhash64(w)), of)).otherwise(F.array().cast("array<bigint>"))


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the other counts that `ratios` reads) of each row."""
    space = r"[ \t-\r]+"
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNotNull().alias("has_text"))
    split = rows.select(
        "doc_id", F.filter(F.split("text", space), lambda w: w != "").alias("words"),
        F.length(F.regexp_replace("text", space, "")).alias("word_chars"), F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).alias("n_symbols"),
        F.when(F.col("has_text"), F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]")))).otherwise(F.array().cast("array<string>")).alias("lines"),
    )
    split = split.select("*", windows(F.col("words")).alias("windows"))
    size_where = lambda c, test: F.size(F.filter(c, test))
    return split.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.col("word_chars").cast("long"), F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words"), F.col("windows")).cast("long").alias("n_repeat_words"),
        size_where("words", lambda w: F.lower(w).isin(*STOP_WORDS)).cast("long").alias("n_stop_words"), F.size("lines").cast("long").alias("n_lines"),
        size_where("lines", lambda x: F.rlike(x, F.lit(r"^[ \t-\r]*[-*•·‣▪]"))).cast("long").alias("n_bullet_lines"),
        size_where("lines", lambda x: F.rlike(x, F.lit(r"(\.\.\.|…)[ \t-\r]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def _per(n: str, of: str, times: int = 1) -> Column:
    return F.when(F.col(of) > 0, times * F.col(n) / F.col(of)).otherwise(0.0)


def ratios() -> dict[str, Column]:
    """What thresholds may be set on, as expressions over `counts`."""
    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_words_percent": _per("n_repeat_words", "n_words", 100),
        "mean_word_length": _per("word_chars", "n_words"),
        "symbols_per_word": _per("n_symbols", "n_words"),
        "stop_word_share": F.when(F.col("n_words") >= STOP_WORDS_FROM, _per("n_stop_words", "n_words")).otherwise(1.0),
        "dup_line_share": _per("n_dup_lines", "n_lines"),
        "bullet_line_share": _per("n_bullet_lines", "n_lines"),
        "ellipsis_line_share": _per("n_ellipsis_lines", "n_lines"),
    }


def compiled(thresholds: Sequence[Threshold] = THRESHOLDS) -> dict[str, Column]:
    """For each threshold whether a row breaks it."""
    known = ratios()
    broken = lambda c, low, high: reduce(Column.__or__, [c < low] * (low is not None) + [c > high] * (high is not None), F.lit(False))
    return {name: broken(known[name], low, high) for name, low, high in thresholds}


def judge(counted: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """`counted` with base_failed, kept and failed (the names of the thresholds that a row breaks, in the table's order). All thresholds
    are one projection."""
    broken = compiled(thresholds)
    failed = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in broken.items()]), lambda x: x.isNotNull()) if broken else F.array().cast("array<string>")
    either = lambda cs: reduce(Column.__or__, cs, F.lit(False))
    base = either([c for name, c in broken.items() if name in BASE])
    return counted.select("*", base.alias("base_failed"), (~either(broken.values())).alias("kept"), failed.alias("failed"))


def quality_rules(docs: DataFrame, thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """Counts and verdict of each row of `docs` (doc_id, text)."""
    return judge(counts(docs), thresholds)
