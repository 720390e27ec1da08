import random

import numpy as np
import pytest
import xxhash

from plateflow.llm import shingle_links as L
from plateflow.llm import simhash_dedup as S
from plateflow.llm.components import connected_components
from plateflow.llm.queries import op2_simhash_dedup

from .helpers import clashing, documents


def plain_simhash(text, k=3):
    import re

    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    codes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def components(fps, radius):
    """The least index that is reachable, by comparing all pairs."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and top(i) != top(j):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(fps))]


def test_simhash():
    for t in (None, "", " \t\n", "one", "Two Words", "a b c", "A B c d É é x", "x y " * 5000):
        assert S.simhash(t) == plain_simhash(t)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_masks_cover(radius):
    rng, masks = random.Random(radius), S.masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(3000):
        bits = rng.sample(range(64), radius)
        assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_tables(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    fps = [plain_simhash(r["text"]) for r in rows]
    want = {r["doc_id"]: (f"{f:016x}", rows[c]["doc_id"]) for r, f, c in zip(rows, fps, components(fps, 3))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash_dedup(spark, sf).collect()} == want


@pytest.mark.parametrize("bucket", [S.BUCKET, 4])
def test_links(spark, bucket):
    """Chains and clouds of fingerprints give the components of all pairs, whatever the size of a bucket."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        f = rng.choice(fps)
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            f ^= 1 << b
        fps.append(f)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = {r["node"]: r["root"] for r in connected_components(S.links(df, 3, bucket)).collect()}
    groups, want = {}, {}
    for f, c in zip(signed, components(fps, 3)):
        groups.setdefault(found.get(f, f), set()).add(f)
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_edges(spark):
    texts = [None, "", "a b c d e f g", "a b c d e f g", "A b c d e f G", "w " * 30_000]
    got = S.near_duplicates(clashing(documents(spark, texts + texts[2:3], ids=[9, 4, 3, 2, None, 8, 3]))).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[9] == by[4] == 4 and by[3] == by[2] == by[None] == 2 and by[8] == 8
    assert S.near_duplicates(documents(spark, [""]).where("false")).collect() == []


def test_keep_one(spark):
    texts = ["the same text of some words " * 5] * 3 + ["another text that stands alone here"] + [None, ""]
    df = clashing(documents(spark, texts + texts[:1], ids=[5, 3, 4, 9, 7, 8, 3]))
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 9]
    assert S.keep_one(df.where("false")).collect() == []


def test_components(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)] + [(5000, x) for x in range(4000, 4200)] + [(7, 7), (7, 8)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(n + 1)) and all(found[i] == 4000 for i in (*range(4000, 4200), 5000))
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def jaccard(x, y, shingle=5):
    a, b = ({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if (w := S.WORD.findall(t.translate(S.LOWER))) else set() for t in (x, y))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_keep_one_links_whatever_is_similar(spark):
    """Texts at a Jaccard similarity of 0.8 or more are linked however many bits their fingerprints differ in."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for k in range(30):
        base = [word() for _ in range(rng.randrange(30, 300))]
        for _ in range(4):
            other = list(base)
            for _ in range(rng.randrange(1, 2 + len(base) // 25)):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    texts += ["a b", "A  b", "", "c", "one two three four five"]
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    far = 0
    for i, x in enumerate(texts):
        for j in range(i):
            bits = (S.simhash(x, 5) ^ S.simhash(texts[j], 5)).bit_count()
            near = jaccard(x, texts[j]) >= 0.8
            far += near and bits > 3
            if near or bits <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = S.keep_one(documents(spark, texts).repartition(3), least=0.8)
    assert far > 10 and sorted(r["doc_id"] for r in kept.collect()) == [i for i in range(len(texts)) if find(i) == i]
    assert S.keep_one(documents(spark, texts).where("false"), least=0.8).collect() == []


def near_roots(texts, least=0.8):
    """The least place that each text is linked with by similarity alone, by comparing all pairs."""
    sets, root = [set(S.shingle_codes(t, 5).tolist()) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and (shared := len(x & sets[j])) >= least * (len(x) + len(sets[j]) - shared):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def found_roots(spark, texts, bucket=L.BUCKET):
    df = documents(spark, texts).repartition(3)
    codes = [S.shingle_codes(t, 5) for t in texts]
    own = [L.signed(np.unique(c)) for c in codes]
    marks = spark.createDataFrame([(i, *(x.tolist() if isinstance(x, np.ndarray) else bytearray(x) if isinstance(x, bytes) else x for x in L.sketch(c))) for i, c in enumerate(codes)], "id long, " + L.SKETCH)
    links = [(own.index(r["a"]), own.index(r["b"])) for r in L.similar(df, marks, lambda t: S.shingle_codes(t, 5), least=0.8, bucket=bucket).collect()]
    root = list(range(len(texts)))
    for a, b in links:
        low, high = sorted((root[a], root[b]))
        root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("bucket", [L.BUCKET, 6])
def test_similar_links_crowds_without_loss(spark, bucket):
    """In crowds of texts about as similar as the threshold, and with a line that all share, no link between groups is lost."""
    rng = random.Random(3)
    words = lambda n: ["".join(rng.choices("abcdefghij", k=5)) for _ in range(n)]
    line, texts = words(12), []
    for _ in range(4):
        base = words(160)
        for _ in range(90):
            other = list(base)
            for at in rng.sample(range(160), rng.choice([3, 4, 4, 5])):
                other[at] = words(1)[0]
            texts.append(" ".join(other + line))
    want = near_roots(texts)
    assert len(texts) > len(set(want)) > 8
    assert found_roots(spark, texts, bucket) == want


def test_similar_decides_large_sets_exactly(spark):
    """One shingle more or less decides, in sets that are compared in parts too."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    texts = []
    for n in (3000, 9000, 5000, 20_000, 4100):
        base = [word() for _ in range(n + 4)]
        most = n + int(0.25 * n)  # n / most is 0.8, or just more
        for extra in (0, 1):
            texts.append(" ".join(base + [word() for _ in range(most - n + extra)]))
        texts.append(" ".join(base))
    want = near_roots(texts)
    assert found_roots(spark, texts) == want and len(set(want)) < len(texts)


def shuffled(spark):
    """Files of shuffles that are on disk."""
    from pathlib import Path

    return {p for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*")}


@pytest.mark.parametrize("ids", [None, [0, 1, 2, 3, 3, 3, 4, None, None]])
def test_keep_one_leaves_no_shuffles_and_shuffles_no_texts(spark, ids):
    """What its steps have shuffled is gone when they end, and the texts that stay are found where they are read."""
    import time

    from plateflow.llm.common import releasing

    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(80)]
    texts = [" ".join(base), " ".join(base), " ".join(base[:70]), " ".join(base[::-1]), " ".join(base[:40]), " ".join(base[:40]), "a b", None, "c d"]
    name, before = "spark.sql.autoBroadcastJoinThreshold", shuffled(spark)
    release = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    told = spark.conf.get(release, None)
    df = documents(spark, texts, ids)
    spark.conf.set(name, "-1")
    try:
        kept = S.keep_one(df, least=0.8)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        end = time.time() + 5
        while (left := shuffled(spark) - before) and time.time() < end:
            time.sleep(0.1)
        assert not left
        if ids is None:
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        rows = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept.collect())
        assert rows == sorted((-1 if i is None else i, texts[k] or "") for k, i in ([(x, x) for x in (0, 3, 4, 6, 7, 8)] if ids is None else [(0, 0), (3, 3), (4, 3), (6, 4), (7, None), (8, None)]))
    finally:
        spark.conf.unset(name)
    with pytest.raises(ZeroDivisionError), releasing(spark):
        assert spark.conf.get(release) == "true"
        1 / 0  # noqa: B018
    assert spark.conf.get(release, None) == told


def test_rounds_read_shared_keys_alone(spark):
    """Keys that one set has are left out before the rounds; no row of another key is."""
    rows = [(1, 10), (2, 10), (1, 11), (3, 12), (2, 13), (3, 13), (4, 13)]
    assert sorted(tuple(r) for r in L._shared(spark.createDataFrame(rows, "own long, key long")).select("own", "key").collect()) == sorted(r for r in rows if r[1] in (10, 13))


def test_meetings_come_in_bounded_batches():
    """A place where all sets meet gives all their pairs, at most 65,536 in a batch."""
    import pyarrow as pa

    n = 1024
    own = pa.array(range(n), pa.int64())
    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), own, pa.array(np.full(n, (100 << 32) | 100)), own], names=["key", "own", "size", "label"])
    found = list(L._Meetings(0.8, L.BUCKET)([rows]))
    assert max(b.num_rows for b in found) <= 1 << 16
    pairs = [p for b in found for p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
    assert len(pairs) == n * (n - 1) // 2 and all(a < b for a, b in set(pairs)) and len(set(pairs)) == len(pairs)


def test_few_links_are_joined_by_the_driver(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1400)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    rows = lambda found: sorted((r["node"], r["root"]) for r in found.collect())
    want = rows(connected_components(df))
    assert rows(connected_components(df, 10_000)) == rows(connected_components(df, 5)) == want
    assert connected_components(df.where("false"), 5).collect() == []
