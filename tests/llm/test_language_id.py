import itertools
import random

import numpy as np
import pytest

from plateflow.llm import language_id as L
from plateflow.llm.queries import op4_language_id

from .helpers import clashing, documents


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    lengths, k = [1, 4, 2, 5], 3
    scores, moves, first = rng.normal(size=(sum(lengths), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    begins = np.zeros(sum(lengths), bool)
    begins[np.cumsum([0, *lengths[:-1]])] = True
    got, expected, log_z = L.forward_backward(scores, begins, moves, first)
    want, pairs, total, at = np.zeros_like(scores), np.zeros((k, k)), 0.0, 0
    for n in lengths:
        weights = {p: np.exp(first[p[0]] + sum(scores[at + i, x] for i, x in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in itertools.product(range(k), repeat=n)}
        z = sum(weights.values())
        total += np.log(z)
        for p, w in weights.items():
            for i, x in enumerate(p):
                want[at + i, x] += w / z
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w / z
        at += n
    assert np.allclose(got, want) and np.allclose(expected, pairs) and np.isclose(log_z, total)


@pytest.fixture(scope="module")
def model():
    rng = random.Random(2)
    word = lambda parts: "".join(rng.choices(parts, k=rng.randrange(1, 4)))
    kinds = {"xx": ["the", "ing", "wh", "ed"], "yy": ["ich", "sch", "ung", "ü"], "zz": ["eau", "què", "oi", "ment"]}
    texts, labels = zip(*[(" ".join(word(p) for _ in range(40)) + ".", k) for k, p in kinds.items() for _ in range(30)])
    return L.train(list(texts), list(labels))


def test_code_switching(spark, model):
    row = L.label_words(documents(spark, ["theing whed edthe 12 schung ichü eauquè oi, mentoi", None]), model).orderBy("doc_id").collect()
    assert [w["lang"] for w in row[0]["words"]] == ["xx"] * 3 + ["yy"] * 2 + ["zz"] * 3 and row[1]["words"] == []
    assert [w["word"] for w in row[0]["words"]] == ["theing", "whed", "edthe", "schung", "ichü", "eauquè", "oi", "mentoi"]
    assert (np.diag(model.transitions) > model.transitions.max(axis=1) - 1e-9).all()


def test_edges(spark, model):
    texts = [None, "", "12 %% !?", "theing", "schung " * 40_000, "日本語 テキスト", "á ٣ _x_", "theing. " * 200]
    got = {r["doc_id"]: r for r in L.identify(clashing(documents(spark, texts)), model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["und", "und", "und", "xx", "yy"] and got[0]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in {"und", "xx", "yy", "zz"} for r in got.values())
    assert L.identify(documents(spark, ["a", None]), None).select("lang_pred", "score").distinct().collect() == [("und", 0.0)]
    assert L.identify(documents(spark, [""]).where("false"), model).collect() == []
    mixed = ["theing schung eauquè. whed ichü mentoi. edthe ungsch oieau."]  # three languages in equal parts are known all the same
    assert L.keep_known(documents(spark, mixed), model).count() == 1
    kept = L.keep_known(clashing(documents(spark, texts)), model)
    assert {3, 4, 7} <= {r["doc_id"] for r in kept.collect()} and not {0, 1, 2} & {r["doc_id"] for r in kept.collect()}


def test_sample_reads_whole_texts(spark):
    """Chains come from all of a text, not from its beginning, and no document gives more than so many."""
    text = ". ".join(f"word{'abcdefghij'[i % 10]} number{'abcdefghij'[i // 100 % 10]}" for i in range(1000))
    chains = L.chains_of(text, "7").split("\n")
    assert len(chains) == L.SAMPLE_CHAINS and len({c[-1] for c in chains}) >= 7
    assert L.chains_of("one two. " + "x" * 100 + " three", "7") == "one two\nthree"
    assert all(len(c.split()) <= L.CHAIN for c in L.chains_of("w " * 1000, "7").split("\n"))
    texts, labels = L.sample(documents(spark, [text, None, "b c"], langs=["xx", "xx", "yy"]), "text", "lang", "doc_id")
    assert sorted(labels) == ["xx", "yy"] and max(len(t.split("\n")) for t in texts) == L.SAMPLE_CHAINS


def test_nothing_to_learn_from(spark):
    assert L.fit(documents(spark, ["a", "b"])) is None and L.fit(documents(spark, [None, "7"], langs=["xx", "yy"])) is None


def test_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op4_language_id(spark, sf).collect()
    assert len(rows) == len(truth)
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out]) > 0.97


def test_labels_of_held_out_rows_do_not_count(spark, sf):
    """Other labels, sources and ids of the test rows leave every prediction as it is."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf}/documents.parquet")
    spoilt = df.withColumn("lang", F.when(L.held_out(), "qq").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    key = lambda d: sorted(map(tuple, L.digest_columns(d).collect()))
    assert key(df) == key(spoilt)
