import random

from plateflow.llm import decontaminate as D
from plateflow.llm.queries import op6_decontaminate

from .helpers import clashing, documents

ITEMS = "item_id long, text string"


def made():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopé", k=rng.randrange(3, 8)))
    items = [[word() for _ in range(n)] for n in (40, 13, 12, 5, 4, 60, 20)]
    texts, leaks = [], set()
    for i in range(80):
        body = [word() for _ in range(rng.randrange(0, 200))]
        if i % 2:
            k = rng.randrange(len(items))
            part = list(items[k])
            if len(part) >= 20:
                for at in range(rng.randrange(4, 8), len(part), rng.randrange(8, 14)):
                    part[at] = word()
                part = part[: rng.randrange(16, len(part) + 1)]
            at = rng.randrange(len(body) + 1)
            body[at:at] = part
            leaks.add((i, k))
        texts.append(rng.choice([" ", ", ", "\n"]).join(body).title())
    return [" ".join(x) for x in items], texts, leaks


def test_brute_force(spark):
    items, texts, leaks = made()
    want = {(i, k) for i, t in enumerate(texts) for k, x in enumerate(items) if D.brute_force(t, x)}
    assert want == leaks
    benchmark = spark.createDataFrame(list(enumerate(items)), ITEMS)
    got = D.contaminated(clashing(documents(spark, texts)), clashing(benchmark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    for r in got:
        assert r["agreeing"] >= D.AGREE * r["tokens"] and r["tokens"] <= r["item_tokens"]
        s = r["spans"][0]
        assert len(D.TOKEN.findall(texts[r["doc_id"]][s["start"] : s["end"]])) in {x for x in range(4, 61)}
    kept = D.decontaminated(documents(spark, texts), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == set(range(len(texts))) - {i for i, k in leaks if len(items[k].split()) >= 5}


def test_short_items(spark):
    """Items of one token and more are found verbatim, with a parameter that rules from how many tokens on."""
    texts, items = ["yes", "Yes, it is", "no it is not", "", None, "it it it it"], ["yes", "it is", "", None, "?!", "it"]
    benchmark = spark.createDataFrame(list(enumerate(items)), ITEMS)
    got = {(r["doc_id"], r["item_id"], len(r["spans"])) for r in D.contaminated(documents(spark, texts), benchmark).collect()}
    assert got == {(0, 0, 1), (1, 0, 1), (1, 1, 1), (2, 1, 1), (1, 5, 1), (2, 5, 1), (5, 5, 4)}
    assert {(i, k) for i, k, _ in got} == {(i, k) for i, t in enumerate(texts) for k, x in enumerate(items) if D.brute_force(t, x)}
    assert {r["item_id"] for r in D.contaminated(documents(spark, texts), benchmark, shortest=2).collect()} == {1}
    assert D.decontaminated(documents(spark, texts), benchmark).count() == len(texts)


def test_frequent_seeds_are_met_in_parts(monkeypatch):
    """Texts and items that say one word over and over have as many hits as both together; the result doesn't depend on the parts."""
    texts, items = ["la " * 90 + "x y", "a b c"], ["la " * 40, "la " * 15 + "x"]
    want = D.find(texts, D.Seeds.of([0, 1], items))
    monkeypatch.setattr(D, "AT_ONCE", 7)
    assert D.find(texts, D.Seeds.of([0, 1], items)) == want and {(t, i) for t, i, _ in want} == {(0, 0), (0, 1)}


def test_equal_items(spark):
    """Each of many equal items has its row."""
    item = " ".join(f"word{i}" for i in range(20))
    benchmark = spark.createDataFrame([(i, item) for i in range(300)], ITEMS)
    got = D.contaminated(documents(spark, [f"before {item} after", "nothing"]), benchmark).collect()
    assert sorted(r["item_id"] for r in got) == list(range(300)) and {r["doc_id"] for r in got} == {0}


def test_masks_leave_no_window_out():
    """Any two replaced tokens of OVERLAP ones leave a place for a mask."""
    import itertools

    shapes = [[i for i, x in enumerate(m) if x == "1"] for m in D.MASKS]
    for replaced in itertools.combinations(range(D.OVERLAP), 2):
        assert any(not {at + i for i in s} & set(replaced) for m, s in zip(D.MASKS, shapes) for at in range(D.OVERLAP - len(m) + 1))


def replaced_at_most(size):
    """All stretches of so many tokens with as many replaced as AGREE lets, as bits."""
    import itertools

    return [(1 << size) - 1 - sum(1 << i for i in places) for places in itertools.combinations(range(size), size // 5)]


def test_masks_reach_the_share_that_must_agree():
    """Lengths of OVERLAP to 2 * OVERLAP - 1 add up to any longer one, so these settle all."""
    assert D.AGREE == 0.8
    masks = [int(m, 2) for m in D.MASKS]
    for size in range(D.OVERLAP, 2 * D.OVERLAP):
        for x in replaced_at_most(size):
            assert any(x >> at & m == m for m in masks for at in range(size - m.bit_length() + 1)), f"{x:b}"


def test_brute_force_at_the_share_that_must_agree():
    """Passages of 15 to 18 tokens with 3 replaced, wherever these are, and long ones with a fifth replaced."""
    rng = random.Random(5)
    patterns = [(size, x) for size in range(15, 19) for x in replaced_at_most(size)]
    patterns += [(30, x) for x in (0b110110110111111110110110111111, 0b111011101110111111011101110111, 0b110111011011111110111011011111)]
    items, texts = [], []
    for k, (size, x) in enumerate(patterns):
        words = [f"w{k}x{i}" for i in range(size)]
        items.append(" ".join(words))
        texts.append(" ".join(["before", *(w if x >> i & 1 else f"other{rng.randrange(10**9)}" for i, w in enumerate(words)), "after"]))
    want = {k for k, (t, x) in enumerate(zip(texts, items)) if D.brute_force(t, x)}
    got = {(t, i) for t, i, _ in D.find(texts, D.Seeds.of(list(range(len(items))), items))}
    assert got == {(k, k) for k in want} and len(want) > 1500


def test_slices(spark, monkeypatch):
    items, texts, leaks = made()
    monkeypatch.setattr(D, "SLICE_TOKENS", 20)
    benchmark = spark.createDataFrame(list(enumerate(items)), ITEMS)
    assert len(list(D._slices(benchmark, "item_id", "text"))) > 2
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(documents(spark, texts), benchmark).collect()} == leaks


def test_tables(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = {(r["doc_id"], x["item_id"]) for r in docs for x in items if D.brute_force(r["text"], x["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in op6_decontaminate(spark, sf).collect()}
    verbatim = {(r["doc_id"], x["item_id"]) for r in docs for x in items if " ".join(D.TOKEN.findall(x["text"].lower())) in " ".join(D.TOKEN.findall(r["text"].lower()))}
    assert got == want and verbatim <= got


def test_edges(spark):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "İstanbul one two three four"), (None, "one two three four five six")], ITEMS)
    texts = [None, "", "x İSTANBUL One-two, three_four y", "one two three four five six seven", "z " * 100_000]
    got = {(r["doc_id"], r["item_id"]): [tuple(s) for s in r["spans"]] for r in D.contaminated(documents(spark, texts), benchmark).collect()}
    assert set(got) == {(3, None), (2, 3)} and got[3, None] == [(0, 27)]
    empty = spark.createDataFrame([], ITEMS)
    assert D.contaminated(documents(spark, texts), empty).collect() == [] and D.decontaminated(documents(spark, texts), empty).count() == 5
    assert D.contaminated(documents(spark, [""]).where("false"), benchmark).collect() == []
