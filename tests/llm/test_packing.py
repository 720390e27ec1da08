import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from plateflow.llm import packing as K
from plateflow.llm.queries import op7_packing, tokenizer_path

from .helpers import clashing, documents

TEXTS = [None, "", "one", "Don't stop; it's HERE <|endoftext|> we're", "Écoute ÀÉÎ õ ÿ ß × ÷ 12 345", "日本語 текст — “quoted” … naïve", "a" * 9000 + " " + "b c d " * 9000, "\t tab space\x0bvt\x85nel", "{}[]() $$$ &&& *** 3.14 1,000 ''s 'Tis", "word " * 2048, "İstanbul ŞAPKA ẞ ǅ ﬁ", " \n \n"]


@lru_cache(1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 1]


def checked(rows, wanted, capacity=2048):
    """Pieces cover each document once, sequences are gapless and short enough; returns the share of padding."""
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc, pieces in own.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(wanted[doc]) and p["length"] > 0
            at += p["length"]
            part = np.array(wanted[doc][p["start"] : at], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(part) if "ids_crc32" in p else p["ids"] == part
        assert at == len(wanted[doc])
    padding = total = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
        total += at
    return padding / max(1, total)


def test_against_the_library(spark):
    rows = [r.asDict() for r in K.pack(clashing(documents(spark, TEXTS).coalesce(1)), tokenizer_path()).collect()]
    assert checked(rows, {i: expected(t) for i, t in enumerate(TEXTS)}) < 0.03
    assert {r["doc_id"] for r in rows} == set(range(len(TEXTS)))


def test_tables(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r.asDict() for r in op7_packing(spark, sf).collect()]
    assert {r["doc_id"] for r in rows} == set(texts)
    assert checked(rows, {i: expected(t) for i, t in texts.items()}) < 0.03


def test_remembered_stretches_stay_right():
    t = K.WordTokenizer(tokenizer_path())
    for _ in range(3):
        assert t.encode([x or "" for x in TEXTS]) == [np.array(expected(x)[:-1], "<u4").tobytes() for x in TEXTS]


def test_empty_table_and_repeats(spark):
    assert K.pack(documents(spark, [""]).where("false"), tokenizer_path()).collect() == []
    rows = K.pack(documents(spark, ["same words"] * 3, ids=[5, 5, None]), tokenizer_path()).collect()
    assert sorted(str(r["doc_id"]) for r in rows if r["start"] == 0) == ["5", "5", "None"]


def test_differencing():
    rng = np.random.default_rng(1)
    for k in (1, 2, 7, 40):
        sizes = rng.integers(1, 500, 12 * k).tolist()
        windows = K.karmarkar_karp(sizes, k)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert max(sums) - min(sums) <= 60
    assert sorted(map(len, K.karmarkar_karp([8, 7, 6, 5, 4], 2))) == [2, 3]  # 8 + 6 against 7 + 5 + 4: the textbook's result
    windows = K.deal([1500, 1500, 1500], 2048)
    assert len(windows) == 3  # the least number of windows, 3, for a sum of 4500
    assert len(K.deal([1300, 1300, 1300], 2048)) == 3  # two windows would do for the sum, but not for the pieces


def thue_morse(order):
    a, b = "a", "b"
    for _ in range(order):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark):
    """Words of 1,024 and 2,048 letters that have one hash modulo 2 ** 64, in one block and in several."""
    texts = [x for order in (10, 11) for x in thue_morse(order)] * 2
    want = [np.array(expected(x)[:-1], "<u4").tobytes() for x in texts]
    t = K.WordTokenizer(tokenizer_path())
    assert t.encode(texts) == want
    assert [t.encode([x])[0] for x in texts] == want
    rows = [r.asDict() for r in K.pack(documents(spark, texts).repartition(3), tokenizer_path()).collect()]
    checked(rows, {i: expected(x) for i, x in enumerate(texts)})


def test_equal_hashes_are_verified(monkeypatch):
    """With a hash that is the same for all words the ids are right all the same."""
    real = K.stretches
    monkeypatch.setattr(K, "stretches", lambda *a: (*(x := real(*a))[:2], np.zeros(len(x[0]), np.uint64)))
    t = K.WordTokenizer(tokenizer_path())
    for text in ("one two", "two one one", "three"):
        assert t.encode([text]) == [np.array(expected(text)[:-1], "<u4").tobytes()]


def test_no_padding_however_rows_are_dealt(spark):
    """Each partition has full sequences and such of powers of two, whatever their number."""
    rng = np.random.default_rng(5)
    texts = ["word and " * int(n) for n in rng.integers(0, 900, 150)]
    want = {i: expected(t) for i, t in enumerate(texts)}
    for parts in (1, 7, 40):
        rows = [r.asDict() for r in K.pack(documents(spark, texts).repartition(parts), tokenizer_path()).collect()]
        assert checked(rows, want) == 0
