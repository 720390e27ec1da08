import hashlib
import random

import numpy as np
import pytest

from plateflow.llm import fingerprints as P
from plateflow.llm.queries import op3_fingerprints

from .helpers import clashing, documents


def plain_chunks(data):
    """Normalised gear chunking, byte by byte."""
    out, start = [], 0
    while start < len(data):
        h = 0
        for i in range(start, len(data)):
            h = ((h << 1) + int(P.GEARS[data[i]])) & 0xFFFFFFFF
            n = i + 1 - start
            if n >= P.LEAST and n < P.NORMAL and h >> (32 - P.STRICT) == 0 or n >= P.NORMAL and h >> (32 - P.LOOSE) == 0 or n == P.GREATEST:
                break
        out.append(data[start : i + 1])
        start = i + 1
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh éß", k=rng.randrange(1, 9))) for _ in range(300)]
    return [" ".join(rng.choices(words, k=rng.randrange(0, 400))) for _ in range(30)] + ["", "x" * 5000, "short"]


def test_chunks(texts):
    import xxhash

    for got, t in zip(P.chunk_sets(texts), texts):
        assert got == {xxhash.xxh64_intdigest(c): len(c) for c in plain_chunks(t.encode())}
        assert P.read(P.written(got)) == got


def test_shift_resistance(texts):
    t = " ".join(texts[:8])
    a, b = P.chunk_sets([t, "an insertion " + t[:100] + "here" + t[100:]])
    assert P.containment(a, b) > 0.5 and P.likeness(a, b) > 0.5
    assert P.likeness({}, {}) == 1 and P.likeness({}, a) == P.likeness(a, {}) == 0 and P.likeness(a, a) == 1


def wanted(rows):
    """By plain loops, from (doc_id, text) rows."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + other[:half]
        a, b, c = P.chunk_sets([t, edited, other])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), P.written(a), P.written(b), P.likeness(a, b), P.likeness(a, c)))
    return out


def check(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted([tuple(r) for r in got], key=key) == sorted(wanted(rows), key=key)


def test_neighbours(spark, texts):
    ids = [*range(0, 3 * len(texts), 3)]
    random.Random(1).shuffle(ids)
    rows = [*zip(ids, texts), (3, "again"), (None, "no id"), (500, None)]
    df = documents(spark, [t for _, t in rows], ids=[i for i, _ in rows])
    check(P.edited_neighbours(clashing(df).repartition(3)).collect(), rows)


def test_few(spark):
    check(P.edited_neighbours(documents(spark, ["alone here"])).collect(), [(0, "alone here")])
    check(P.edited_neighbours(documents(spark, ["a", "b"], ids=[None, None])).collect(), [(None, "a"), (None, "b")])
    assert P.edited_neighbours(documents(spark, [""]).where("false")).collect() == []


def test_tables(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(op3_fingerprints(spark, sf).collect(), rows)
    near = np.array([(r[5], r[6]) for r in wanted(rows)])
    assert near[:, 0].mean() > 0.3 > near[:, 1].mean()


def test_fingerprint(spark, texts):
    got = {r["doc_id"]: r["fingerprint"] for r in P.fingerprint(clashing(documents(spark, [*texts, None]))).collect()}
    assert got == {i: P.written(c) for i, c in enumerate(P.chunk_sets([*texts, ""]))}
