import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline
from plateflow.llm import decontaminate, language_id, secret_scan

from .helpers import DOCUMENTS
from .test_packing import checked, expected
from .test_simhash_dedup import plain_simhash


class Held:
    """In place of a broadcast."""

    def __init__(self, value):
        self.value = value


def near_roots(texts):
    """The least place that each text is linked with, by fingerprints or by a Jaccard similarity of 0.8 or more."""
    marks = [plain_simhash(t, 5) for t in texts]
    words = [re.findall("[^\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    roots = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            near = (marks[i] ^ marks[j]).bit_count() <= 3 or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            if near and roots[i] != roots[j]:
                low, high = sorted((roots[i], roots[j]))
                roots = [low if r == high else r for r in roots]
    return roots


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "secret_scan", "packing"]


def test_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    model = language_id.fit(docs.where(~language_id.held_out()))
    rows = sorted(docs.collect(), key=lambda r: r["doc_id"])
    langs, _, sure = language_id.Labeller(Held(model))([r["text"] for r in rows])
    rows = [r for r, x, s in zip(rows, langs, sure) if x != "und" and s >= 0.5]
    roots = near_roots([r["text"] for r in rows])
    rows = [r for i, (r, c) in enumerate(zip(rows, roots)) if i == c]
    rows = [r for r in rows if not any(decontaminate.brute_force(r["text"], x) for x in items)]
    want = {}
    for r in rows:
        spans = sorted((m.start(x.mask), m.end(x.mask)) for x in secret_scan.RULES for m in x.compiled().finditer(r["text"]) if len(m[x.group]) >= x.least)
        text, at = "", 0
        for a, b in spans:
            if a >= at:
                text += r["text"][at:a] + "[SECRET]"
            at = max(at, b)
        want[r["doc_id"]] = expected(text + r["text"][at:])
    packed = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    assert {r["doc_id"] for r in packed} == set(want) and 0 < len(want) < docs.count()
    assert checked(packed, want) < 0.05


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_empty_and_odd_documents(spark, sf):
    empty = spark.createDataFrame([], DOCUMENTS)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "the same words of a text", None, "s", 24), (1, "the same words of a text", None, "s", 24), (2, "12 34", None, None, 5)], DOCUMENTS)
    for df in (empty, odd):
        out = df
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, out, sf)
        rows = out.collect()
        assert bool(rows) == (df is odd)
