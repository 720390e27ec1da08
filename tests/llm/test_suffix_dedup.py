import random

import numpy as np
import pytest

from plateflow.llm import suffix_dedup as D

from .helpers import clashing, documents


def corpus(seed, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghé", k=rng.randrange(1, 9))) for _ in range(500)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    passages = [text(rng.randrange(30, 120)) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [text(rng.randrange(0, 80))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(0, 40)
            parts += [p[a : len(p) - rng.randrange(0, 60)], text(rng.randrange(0, 30))]
        out.append("".join(parts))
    out += [out[3], out[3], out[5][:-7] + "x" + out[5][-6:], None, "", "a" * 700, "ab" * 350, "a" * 199, "z" * 200, "z" * 200, "é" * 100, "q" + "é" * 100 + "r", "\x00" * 450, "日本語" * 200]
    return out


def results(spark, texts, parts=3, **more):
    got = D.digest_columns(D.remove_repeats(clashing(documents(spark, texts)).repartition(parts), **more)).collect()
    assert len(got) == len(texts)
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}


@pytest.mark.parametrize("crowd", [D.CROWD, 1])
def test_brute_force(spark, crowd):
    texts = corpus(1)
    assert results(spark, texts, crowd=crowd) == dict(enumerate(D.brute_force(texts)))


def thue_morse(order):
    a, b = "a", "b"
    for _ in range(order):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse(spark, monkeypatch):
    """Strings of one hash modulo 2 ** 64, in one shard and in several, by families and by counts; small families and shards."""
    texts = [x for order in (8, 9, 10, 11) for x in thue_morse(order)] + ["pre " + thue_morse(10)[0], thue_morse(10)[1][:900] + " post"]
    want = dict(enumerate(D.brute_force(texts)))
    monkeypatch.setattr(D, "FAMILY_WINDOWS", 500)
    assert results(spark, texts, parts=1) == want
    assert results(spark, texts, parts=4, crowd=1) == want


def test_copies_within_and_across_shards(spark, monkeypatch):
    """Copies that shards find by themselves, and those that only counts over shards tell."""
    monkeypatch.setattr(D, "SHARD_BYTES", 2000)
    texts = corpus(4, 12) * 3
    assert results(spark, texts, parts=2) == dict(enumerate(D.brute_force(texts)))


def test_families_of_a_task(spark):
    """One task has many families, one after the other, whose borders are those of hashes."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    rows = [(k, 0, 1000 * k + 300 * j, 3, bytes(rng.integers(97, 99, 7, np.uint8))) for k in range(40) for j in range(int(rng.integers(1, 9)))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["k", "shard", "g", "n", "bytes"])
    found = set()
    D.FAMILY_WINDOWS, kept = 20, D.FAMILY_WINDOWS
    try:
        for out in D._Compare(5)(iter([batch.slice(i, 7) for i in range(0, len(rows), 7)])):
            for _, g, n in zip(*(c.to_pylist() for c in out.columns)):
                found |= set(range(g, g + n))
    finally:
        D.FAMILY_WINDOWS = kept
    windows = [(k, g + i, raw[i : i + 5]) for k, _, g, _, raw in rows for i in range(3)]
    assert {g for k, g, w in windows if sum(w == x and k == y for y, _, x in windows) > 1} <= found
    assert found <= {g for _, g, w in windows if sum(w == x for *_, x in windows) > 1}


def test_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = D.digest_columns(D.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"))).collect()
    want = dict(zip([r["doc_id"] for r in rows], D.brute_force([r["text"] for r in rows])))
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert any(x[1] for x in want.values())


def test_small_places(spark, monkeypatch):
    """Stretches that cross the borders of what is handled at once."""
    texts = corpus(2)
    raw = [(t or "").encode() for t in texts]
    monkeypatch.setattr(D, "PLACE_BITS", 10)
    data, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw])
    windows = [w for *_, g, n in D.stretches_of(data, ends, 200) for a, b in zip(g, n) for w in range(a, a + b)]
    assert sorted(windows) == [s + i for s, r in zip(ends - [len(r) for r in raw], raw) for i in range(len(r) - 199)]


def test_family(monkeypatch):
    data = np.frombuffer(b"abracadabra" * 3 + b"xyz", np.uint8)
    family = D.SuffixFamily(data, 5)
    starts = np.arange(len(data) - 4)
    for i in range(0, len(starts), 4):
        family.add(starts[i : i + 4])
    raw = data.tobytes()
    assert len(family.levels) < 6
    want = [raw[:].count(raw[i : i + 5]) > 1 or any(raw[j : j + 5] == raw[i : i + 5] for j in starts if j != i) for i in starts]
    assert family.finish()[starts].tolist() == want


def test_empty(spark):
    assert D.remove_repeats(documents(spark, [""]).where("false")).collect() == []
    got = D.digest_columns(D.remove_repeats(documents(spark, ["k" * 300, "k" * 300], ids=[None, None]))).collect()
    assert [r["n_removed"] for r in got] == [300, 300]
