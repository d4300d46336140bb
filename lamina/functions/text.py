"""Text normalisation as column expressions; everything stays in the JVM.

Order: strip entities, tokenise, lower-case, (stem), filter stop words, join by blanks. Positions of lines are kept even when
nothing of a line remains.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The short stop list, punctuation only, without its first line, as readers of such lists skip it.
SHORT_STOP_LIST = ["`", "-", "--", "+", ":", ";", "``", "''", "[", "]", ".", "?", "!", ","]

#: The word tokenizer: (pattern, replacement) in order. Patterns are in the common subset of Java and RE2.
TOKEN_RULES = [
    (r'(^|[ (\[{<])"', r"\1`` "),
    (r'"', r" '' "),
    (r"([,;:@#$%&?!()\[\]{}<>*|])", r" \1 "),
    (r"--", r" -- "),
    (r"\.( |\z)", r" . \1"),
    (r"n't( |\z)", r" n't \1"),
    (r"'(s|m|d|re|ll|ve|S|M|D|RE|LL|VE)( |\z)", r" '\1 \2"),
]
#: What a line contains if the rule of the same place can apply; most lines lack most of these, and a search is cheap.
_NEEDS = ['"', '"', None, "--", ".", "n't", "'"]


def strip_entities(line) -> Column:
    """Delete from `&` up to the next `;`, as the source material is escaped."""
    return F.when(F.contains(line, F.lit("&")), F.regexp_replace(line, "&[^;]*;", "")).otherwise(line)


def tokenize(line) -> Column:
    """Split punctuation and contractions off words, with blanks."""
    # Each step is a lambda over an array of one, so that it can name its input twice without computing it twice.
    out = F.array(line)
    for (pattern, replacement), needs in zip(TOKEN_RULES, _NEEDS, strict=True):
        out = F.transform(out, _step(pattern, replacement, needs))
    return out[0]


def _step(pattern: str, replacement: str, needs: str | None):
    java = replacement.replace("$", r"\$").replace("\\1", "$1").replace("\\2", "$2")

    def step(v: Column) -> Column:
        done = F.regexp_replace(v, pattern, java)
        return done if needs is None else F.when(F.contains(v, F.lit(needs)), done).otherwise(v)

    return step


def normalize(line, tokenizer: bool = True) -> Column:
    out = strip_entities(line)
    return F.lower(tokenize(out) if tokenizer else out)


def blank_split(line) -> Column:
    """Tokens between blanks (U+0020 only; tabs stay inside tokens), empty ones dropped."""
    return F.filter(F.split(line, " "), lambda t: t != "")


def drop_stop_words(tokens, stop: list[str]) -> Column:
    """Tokens outside a short stop list (for a long one, anti-join the exploded tokens)."""
    words = F.array(*[F.lit(w) for w in stop]) if stop else F.array().cast("array<string>")
    return F.filter(tokens, lambda t: ~F.array_contains(words, t))


# `normalize` for all lines of a text at once, in Python. A line ends at \n only, so `\Z` is \n here, which the text is given at its end.
_ENTITY = re.compile(r"&[^;\n]*;")
_OPENING = re.compile(r'(^|[ (\[{<])"', re.MULTILINE)
_SHORTENED = re.compile(r"'(s|m|d|re|ll|ve|S|M|D|RE|LL|VE)(?=[ \n])")


def normalized(text: str) -> list[str]:
    """`normalize` of each line of `text`, as many as `bow.lines` makes; a few plain replacements do what `TOKEN_RULES` say.
    Letters that are newer than Python's Unicode data stay as they are, as in the SQL."""
    text = text.removesuffix("\n") + "\n"
    if "&" in text:
        text = _ENTITY.sub("", text)
    if '"' in text:
        text = _OPENING.sub(r"\1`` ", text).replace('"', " '' ")
    for sign in ",;:@#$%&?!()[]{}<>*|":
        text = text.replace(sign, f" {sign} ")
    text = text.replace("--", " -- ").replace(". ", " .  ").replace(".\n", " . \n").replace("n't ", " n't  ").replace("n't\n", " n't \n")
    if "'" in text:
        text = _SHORTENED.sub(r" '\1 ", text)
    return text.lower()[:-1].split("\n")
