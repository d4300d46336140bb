import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lamina.llm import token_pack as tp
from lamina.llm.queries import tokenizer_file

SPEC = tokenizer_file("byte_bpe_50k.json")


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 24, 31, 32])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 65, 1000])
def test_pack(width, n):
    ids = np.random.default_rng(n).integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
    data, offsets = tp.pack(ids, width, 64)
    back = [tp.unpack(data[a:b], min(64, n - 64 * i), width) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True))]
    assert np.array_equal(np.concatenate([*back, np.empty(0, np.uint32)]), ids)
    assert len(data) <= n * width / 8 + len(offsets)


def test_image_random_access():
    rng = random.Random(1)
    docs = [np.array([rng.randrange(50_257) for _ in range(rng.choice((0, 1, 30, 300)))], np.uint32) for _ in range(40)]
    im = tp.Image(tp.build_image(list(range(40)), [d.tobytes() for d in docs], tp.bits_for(50_257), 64))
    assert im.width == 16 and im.tokens == sum(map(len, docs))
    for n in rng.sample(range(40), 40):
        assert np.array_equal(im.document(n), docs[n])
    flat = np.concatenate(docs)
    for _ in range(50):
        a, b = sorted(rng.randrange(len(flat) + 1) for _ in range(2))
        assert np.array_equal(im.slice(a, b), flat[a:b])
    with pytest.raises(ValueError):
        tp.Image(b"x" * 64)


def test_encoder_is_the_library(monkeypatch):
    library, own = Tokenizer.from_str(SPEC), tp.CachedEncoder(SPEC)
    rng = random.Random(1)
    alphabet = "abcXYZ'sSlL 12\n\t<|éÉßΣς☃  ,.!%"
    texts = ["", "\n", " ", "a\n", "\na", " a", "a ", "a  b", "a\x00b c", "a<|endoftext|>b", "the, and. the; 3,5 a%%%, x...", "word.\nNext, word", "y" * 300 + " z"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for _ in range(2):
        for t, ids, e in zip(texts, own(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        monkeypatch.setattr(tp, "REMEMBERED", 5)


def test_words_that_share_a_hash(monkeypatch):
    library, own = Tokenizer.from_str(SPEC), tp.CachedEncoder(SPEC)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé1'") for _ in range(rng.randint(1, 6))) + rng.choice(("", ",", "!")) for _ in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    monkeypatch.setattr(tp, "span_hash", lambda total, start, end: (end - start).astype(np.uint64))
    calls = []
    monkeypatch.setattr(own, "by_library", lambda t, f=own.by_library: calls.append(len(t)) or f(t))
    for part in (texts[:100], texts[100:]):
        assert [np.frombuffer(x, "<u4").tolist() for x in own(part)] == [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
    assert sum(calls) == 200


def test_query(spark, docs):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(("the", "ationing,", "x\n", "é", "")) for _ in range(rng.choice((0, 3, 50))))) for i in range(120)]
    rows += [(500, None), (501, "long " * 20_000), (7, rows[7][1])]
    rng.shuffle(rows)
    library = Tokenizer.from_str(SPEC)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = tp.pack_documents(docs(rows), SPEC, 2, 50_257)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()) == sorted(want)
    assert tp.pack_documents(docs([]), SPEC, 2, 50_257).collect() == []


def test_rows_in_order_are_not_shuffled(spark, docs, tmp_path):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(300)]
    ordered = docs(rows).coalesce(1)
    assert tp.ascending_runs(tp.numbered(ordered)) == [(0, 299)]
    assert tp.ascending_runs(tp.numbered(docs(rows[::-1]))) is None and tp.ascending_runs(tp.numbered(docs(rows).repartition(5))) is None
    assert tp.ascending_runs(tp.numbered(docs([*rows, (None, "x")]))) is None and tp.ascending_runs(tp.numbered(docs([]))) == []
    both = [sorted(map(tuple, tp.pack_documents(d, SPEC, 2, 50_257).collect())) for d in (ordered, docs(rows).repartition(7))]
    assert both[0] == both[1]
    # Files that each hold a range, read in any order.
    docs(rows).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").write.parquet(str(tmp_path / "ranges"))
    stored = spark.read.parquet(str(tmp_path / "ranges"))
    assert tp.ascending_runs(tp.numbered(stored)) is not None
    assert sorted(map(tuple, tp.pack_documents(stored, SPEC, 2, 50_257).collect())) == both[0]


def test_order_of_shared_ids_does_not_depend_on_the_layout(spark, docs, tmp_path):
    rows = [(1, "first"), (2, "two words"), (2, "other words, more"), (2, "x"), (2, "x"), (3, "last")] + [(None, f"null {i} " * i) for i in range(6)]
    tables = [docs(rows).coalesce(1), docs(rows[::-1]).coalesce(1), docs(rows).repartition(5), docs(sorted(rows, key=str)).coalesce(1)]
    docs(rows[:6]).coalesce(1).write.parquet(str(tmp_path / "t"))
    results = [sorted(map(tuple, tp.pack_documents(t, SPEC, 2, 50_257).collect()), key=str) for t in tables]
    assert results[0] == results[1] == results[2] == results[3]
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert tp.ascending_runs(tp.numbered(stored)) is None
    assert len({r[1] for r in results[0]}) == len(rows)


def test_many_images_and_export(spark, docs, tmp_path):
    path = str(tmp_path / "images")
    tp.write_images(docs([(i, "a b c d " * 20) for i in range(50)] + [(None, "x")]), SPEC, 2, path, 50_257, block=16, image=200)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"]) for r in tp.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, *range(50)] and all(a[1] + a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    files = tp.export(spark, path, str(tmp_path / "plain"))
    assert len(files) > 10
    total = sum(tp.Image(open(f, "rb").read()).documents for f in files)
    assert total == 51
