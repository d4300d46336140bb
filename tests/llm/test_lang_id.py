import os
import random
import time
import unicodedata
import zlib

import pytest
import zstandard

from lamina.llm import lang_id

WORDS = {"en": "the and of thing ation ing with", "de": "der und schei ung keit nicht ein", "fr": "le que elle eau oux ment tion"}


def text(lang, i, n=60):
    words = WORDS[lang].split()
    return " ".join(words[(i * 7 + k * k) % len(words)] + words[(i + k) % len(words)] for k in range(n))


def test_held_out_accuracy(docs):
    rows = [(i, text(list(WORDS)[i % 3], i), list(WORDS)[i % 3]) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "123 %%% \n"), (903, "é"), (904, text("de", 5, 20_000), None)]
    got = {r["doc_id"]: r for r in lang_id.language_id(docs(rows)).collect()}
    assert len(got) == len(rows)
    for i, t, lang in rows[:150]:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["lang_pred"] == lang and 0 <= r["score"] <= 1 and r["accepted"]
    for i in (900, 901, 902):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
    assert got[903]["lang_pred"] in WORDS and got[904]["lang_pred"] == "de"


def test_labels_of_held_out_rows_are_not_used(docs):
    rows = [(i, text("en", i), "en") for i in range(30)] + [(i, text("de", i), "de") for i in range(30, 60)]
    wrong = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else k) for i, t, k in rows]
    assert lang_id.learn(docs(rows)) == lang_id.learn(docs(wrong))


def brute(dictionaries, t):
    """The language, the margin and whether sizes tied, by plain loops."""
    if t is None or not any(unicodedata.category(c).startswith("L") for c in t):
        return "und", 0.0, False
    letters = [c.lower() if c.isascii() and c.isalpha() else c if not c.isascii() else " " for c in t.lower()]
    body = (" " + " ".join("".join(letters).split(" ")).strip() + " ").encode()
    while b"  " in body:
        body = body.replace(b"  ", b" ")
    sizes = []
    for _, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        c = zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(body[i : i + 1024])) for i in range(0, len(body), 1024)))
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    if sizes[order[0]] < sizes[order[1]]:
        return dictionaries[order[0]][0], 1 - sizes[order[0]] / sizes[order[1]], False
    tied, sums = [i for i in order if sizes[i] == sizes[order[0]]], {}
    for i in tied:
        longest = [max((n for n in range(3, len(body) - a + 1) if body[a : a + n] in dictionaries[i][1]), default=0) for a in range(len(body))]
        sums[i] = sum(longest)
    order = sorted(tied, key=lambda i: (-sums[i], i))
    return dictionaries[order[0]][0], 1 - sums[order[1]] / sums[order[0]] if sums[order[0]] else 0.0, True


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_table_against_plain_python(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    dictionaries = lang_id.learn(table)
    short = [(10_000 + i, t, None) for i, t in enumerate(["a", "Re.", "This.", "der", "de la", "Ein", "les", "½", "²³", "Ⅷ", "①", "_", "７", "中文字", "中文字" * 500, "É", "ª", "the " * 3])]
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()] + short
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ties = 0
    got = {r["doc_id"]: r for r in lang_id.identify(frame, dictionaries).collect()}
    for i, t, _ in rows:
        lang, margin, tied = brute(dictionaries, t)
        ties += tied
        assert (got[i]["lang_pred"], got[i]["accepted"]) == (lang, lang != "und" and margin >= lang_id.MIN_MARGIN), t
        assert got[i]["score"] == pytest.approx(margin / (margin + lang_id.HALF_MARGIN) if margin < 1 else 1.0)
    assert ties > 5 and all(got[i]["lang_pred"] == "und" for i, t, _ in short if t in ("½", "²³", "Ⅷ", "①", "_", "７"))


def test_every_part_of_a_long_text_can_be_learned_from(docs):
    rows = [(i, " ".join(f"w{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}x" for k in range(600)), "en") for i in range(300)]
    (_, content), = lang_id.learn(docs(rows))
    assert len({w for w in content.split() if len(w) == 4}) > 550 and len(content) > 0.95 * 320 * sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(300)) * 0.97


def test_edge_cases(docs):
    assert lang_id.language_id(docs([])).collect() == []
    only = lang_id.language_id(docs([(i, text("en", i), "en") for i in range(9)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in only} == {("en", 1.0)}
    none = lang_id.language_id(docs([(1, "abc", None)])).collect()
    assert [(r["lang_pred"], r["accepted"]) for r in none] == [("und", False)]


def test_accepted_rows_keep_all_columns(docs):
    d = docs([(i, text("en", i), "en") for i in range(9)] + [(i, text("de", i), "de") for i in range(9, 20)] + [(50, "..."), (51, None)])
    kept = lang_id.accepted_rows(d, lang_id.learn(d))
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(20))


def test_automaton_is_the_search(monkeypatch):
    rng = random.Random(4)
    for _ in range(60):
        letters = "abcd"[: rng.randint(1, 4)] + " "
        content = "".join(rng.choice(letters) for _ in range(rng.randrange(300))).encode()
        body = "".join(rng.choice(letters) for _ in range(rng.randrange(200))).encode() + content[10 : 10 + rng.randrange(80)]
        by_search = lang_id.Classifier([("x", content)]).matched(0, body)
        assert lang_id.Matches(content).total(body) == by_search
        longest = [max((n for n in range(3, len(body) - a + 1) if body[a : a + n] in content), default=0) for a in range(len(body))]
        assert by_search == sum(longest)


def test_long_tied_texts_take_seconds():
    """A megabyte that no dictionary knows: all sizes tie."""
    rng = random.Random(5)
    learnt = [(k, " ".join(text(k, i) for i in range(400)).encode()[:128_000]) for k in WORDS]
    classify = lang_id.Classifier(learnt)
    begin = time.monotonic()
    for letters in ("абвгдежзиклмн", "αβγδεζηθικ", "0123456789"):
        t = "".join(rng.choice(letters) for _ in range(1_000_000 // len(letters[0].encode()))) + "é"
        language, margin = classify(t)
        assert language in WORDS and 0 <= margin <= 1
    assert time.monotonic() - begin < 30
