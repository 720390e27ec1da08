"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, character n-grams and, if it is in the lexicon of the training sample, the word itself;
each feature has a learned weight for each language, and neighbouring words have learned transition weights. Forward-backward
gives each word's distribution over languages, so code-switched text gets labels word by word; a document's language is the
one with the most letters by these distributions. Weights maximise the conditional likelihood of a bounded sample of labelled
documents, part of whose sentences are spliced with those of other languages.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import edit_rows, field, per_block, remembered, stretches

#: The training sample: documents of each language, and chains of each, drawn from its whole text; words of over LONGEST
#: letters aren't learned from.
SAMPLE_DOCUMENTS, SAMPLE_CHAINS, LONGEST = 300, 24, 64
#: Hashed feature space; times a word must occur to enter the lexicon; words of a chain at most.
FEATURES, LEXICON, CHAIN = 1 << 18, 3, 64
#: Gradient steps, their size, the penalty on squared weights, and the share of training chains that are spliced.
STEPS, RATE, PENALTY, SPLICED = 40, 0.3, 1e-3, 0.3
#: Words whose scores a worker remembers; characters that are handled at once.
REMEMBERED, AT_ONCE = 400_000, 700_000

WORD = re.compile(r"[^\W\d_]+")
#: Text in which exactly these letters make words: ASCII and Latin-1.
PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
_LETTER, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STOP[[10, 33, 46, 63]] = True  # line feed, !, ., ?


def features(word: str, lexicon: frozenset[str] | set[str]) -> list[int]:
    """Hashed features of a word: prefixes and suffixes of 1 to 3 letters, 2- and 3-grams with its ends, its length, itself."""
    w = word.lower()
    framed = f"^{w}$"
    names = {f"p{w[:n]}" for n in (1, 2, 3)} | {f"s{w[-n:]}" for n in (1, 2, 3)} | {framed[i : i + n] for n in (2, 3) for i in range(len(framed) - n + 1)}
    names.add(f"l{min(len(w), 15)}")
    if w in lexicon:
        names.add(f"w{w}")
    return [xxhash.xxh32_intdigest(x) % FEATURES for x in sorted(names)]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Each word's code, bytes and text, whether it begins a chain, then the distinct words and each word's among them.

    Chains end with sentences, lines and texts, and after CHAIN words.
    """
    raw = [(t if PLAIN.fullmatch(t) else re.sub(r"[\W\d_]", lambda m: m[0] if m[0] in "\n!.?" else " ", t)).encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none, none, none.astype(bool), [], none
    starts, ends, codes = stretches(data, ~_LETTER[data])
    if not len(starts):
        return none, none, none, none.astype(bool), [], none
    text = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    stops = np.cumsum(_STOP[data])
    begins = np.r_[True, stops[starts[1:]] > stops[ends[:-1] - 1]]
    at = np.flatnonzero(begins)
    place = np.arange(len(starts)) - np.repeat(at, np.diff(np.r_[at, len(starts)]))
    begins |= place % CHAIN == 0
    _, first, which = np.unique(codes, return_index=True, return_inverse=True)
    distinct = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    return codes[first], ends - starts, text, begins, distinct, which


def forward_backward(scores: np.ndarray, begins: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each word, the expected number of each transition, and the log of the partition functions' product.

    scores: (words, labels); begins: where chains begin; all chains are advanced together, one word at a time.
    """
    at = np.flatnonzero(begins)
    length = np.diff(np.r_[at, len(begins)])
    order = np.argsort(-length, kind="stable")
    at, length = at[order], length[order]
    top = scores.max(axis=1, keepdims=True)
    emit, move = np.exp(scores - top), np.exp(transitions)
    alpha, beta, scale = np.empty_like(emit), np.ones_like(emit), np.ones(len(emit))
    steps = int(length[0]) if len(length) else 0
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(steps)]  # chains longer than t
    for t in range(steps):
        rows = at[: live[t]] + t
        a = emit[rows] * (alpha[rows - 1] @ move if t else np.exp(first))
        scale[rows] = s = a.sum(axis=1)
        alpha[rows] = a / s[:, None]
    expected = np.zeros_like(move)
    for t in range(steps - 1, 0, -1):
        rows = at[: live[t]] + t
        ahead = emit[rows] * beta[rows] / scale[rows, None]
        beta[rows - 1] = ahead @ move.T
        expected += alpha[rows - 1].T @ ahead * move
    return alpha * beta, expected, float(np.log(scale).sum() + top.sum())


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray
    lexicon: frozenset[str]

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Each word's summed weights."""
        out = np.zeros((len(words), len(self.labels)), np.float64)
        for i in range(0, len(words), 20_000):
            found = [features(w.decode(), self.lexicon) for w in words[i : i + 20_000]]
            size = np.array([len(f) for f in found])
            flat = np.fromiter((x for f in found for x in f), np.int64, size.sum())
            out[i : i + len(found)] = np.add.reduceat(self.weights[flat], np.cumsum(size) - size, axis=0)
        return out


def train(texts: list[str], labels: list[str]) -> Model | None:
    """A model from labelled texts, the same for the same texts in the same order; None without labels or words."""
    names = sorted(set(labels))
    _, _, text, begins, distinct, which = words_of(texts)
    if not names or not len(which):
        return None
    truth = np.array([names.index(x) for x in labels])[text]
    which, truth, begins = _spliced(which, truth, begins)
    counts = Counter()
    for w, n in zip(distinct, np.bincount(which, minlength=len(distinct)).tolist()):
        counts[w.decode().lower()] += n
    lexicon = frozenset(w for w, n in counts.items() if n >= LEXICON)
    found = [features(w.decode(), lexicon) for w in distinct]
    size = np.array([len(f) for f in found])
    flat = np.fromiter((x for f in found for x in f), np.int64, size.sum())
    used, flat = np.unique(flat, return_inverse=True)
    edges, k, n = np.cumsum(size) - size, len(names), len(which)
    weights, transitions, first = np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)
    inner = np.flatnonzero(~begins)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[inner - 1], truth[inner]), 1)
    seen_first = np.bincount(truth[begins], minlength=k)
    gold = np.zeros((len(distinct), k))
    np.add.at(gold, (which, truth), 1)
    state = [np.zeros_like(x) for x in (weights, transitions, first)]
    for _ in range(STEPS):
        scores = np.add.reduceat(weights[flat], edges, axis=0)[which]
        marginals, expected, _ = forward_backward(scores, begins, transitions, first)
        error = gold - np.stack([np.bincount(which, marginals[:, j], len(distinct)) for j in range(k)], axis=1)
        spread = np.repeat(error, size, axis=0)
        ascent = np.stack([np.bincount(flat, spread[:, j], len(used)) for j in range(k)], axis=1)
        slopes = [ascent / n - PENALTY * weights / len(used) ** 0.5, (seen - expected) / n - PENALTY * transitions, (seen_first - marginals[begins].sum(axis=0)) / n - PENALTY * first]
        for x, g, s in zip((weights, transitions, first), slopes, state):  # AdaGrad
            s += g * g
            x += RATE * g / (np.sqrt(s) + 1e-9)
    whole = np.zeros((FEATURES, k), np.float32)
    whole[used] = weights
    return Model(names, whole, transitions, first, lexicon)


def _spliced(which: np.ndarray, truth: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The chains, a share of which are joined: a beginning of one with an end of another, so that languages change within."""
    rng = np.random.default_rng(11)
    at = np.flatnonzero(begins)
    chains = [np.arange(a, b) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(begins)])]
    for i in np.flatnonzero(rng.random(len(chains)) < SPLICED).tolist():
        other = chains[int(rng.integers(len(chains)))]
        cut = int(rng.integers(len(chains[i]) + 1))
        chains[i] = np.r_[chains[i][:cut], other[int(rng.integers(len(other))) :]]
    flat = np.concatenate(chains)
    new = np.zeros(len(flat), bool)
    new[np.cumsum([0, *map(len, chains[:-1])])] = True
    return which[flat], truth[flat], new


def chains_of(text: str, key: str, most: int = SAMPLE_CHAINS) -> str:
    """Chains of a whole text, a line for each: all, or those `most` whose places have the least hashes; in order."""
    found = []
    for sentence in re.split("[\n!.?]+", text):
        words = [w for w in WORD.findall(sentence) if len(w) <= LONGEST]
        found += [" ".join(words[i : i + CHAIN]) for i in range(0, len(words), CHAIN)]
    if len(found) > most:
        found = [found[i] for i in sorted(sorted(range(len(found)), key=lambda i: xxhash.xxh64_intdigest(f"{key}:{i}"))[:most])]
    return "\n".join(found)


def sample(df: DataFrame, text_col: str, label_col: str, key_col: str) -> tuple[list[str], list[str]]:
    """At most SAMPLE_CHAINS chains of each of at most SAMPLE_DOCUMENTS documents of each label, chosen by hashes of key and text.

    The counts that set each label's share cover all rows; chains are drawn from whole texts where these lie, and the
    driver gets the sample alone.
    """
    labelled = df.select(F.col(key_col).cast("string").alias("key"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("label is not null and text is not null")
    counts = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * SAMPLE_DOCUMENTS / n))])
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30))
    chosen = labelled.select("label", "key", draw.alias("draw"), "text").where(F.col("draw") < F.element_at(share, F.col("label")) * F.lit(float(1 << 30)))

    def block(columns):
        labels, keys, draws, texts = columns
        return [labels, draws, [chains_of(t, k or "") for k, t in zip(keys, texts)]]

    rows = per_block(chosen, {c: c for c in chosen.columns}, block, "label string, draw long, text string").collect()
    kept: Counter = Counter()
    texts, labels = [], []
    for r in sorted(rows, key=lambda r: (r["draw"], r["label"], r["text"])):
        if kept[r["label"]] < SAMPLE_DOCUMENTS:
            kept[r["label"]] += 1
            texts.append(r["text"])
            labels.append(r["label"])
    return texts, labels


def fit(df: DataFrame, text_col: str = "text", label_col: str = "lang", key_col: str = "doc_id") -> Model | None:
    """A model from a sample of df's labelled rows."""
    return train(*sample(df, text_col, label_col, key_col))


class Labeller:
    """Labels words and texts; a worker remembers scores of words."""

    def __init__(self, model):
        """model: a broadcast of a Model."""
        self.model = model

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each word's distribution, bytes and text."""
        model = self.model.value
        codes, size, text, begins, distinct, which = words_of(texts)
        if not len(which):
            return np.zeros((0, len(model.labels))), size, text
        own = model.transitions.tobytes() + model.first.tobytes()
        memory = remembered(__name__)
        known, values = memory.get(own, (np.zeros(0, np.uint64), np.zeros((0, len(model.labels)))))
        at = np.minimum(np.searchsorted(known, codes), max(0, len(known) - 1))
        old = known[at] == codes if len(known) else np.zeros(len(codes), bool)
        scores = np.zeros((len(codes), len(model.labels)))
        scores[old] = values[at[old]]
        new = np.flatnonzero(~old)
        scores[new] = model.scores([distinct[i] for i in new.tolist()])
        if len(known) + len(new) <= REMEMBERED:
            known, values = np.r_[known, codes[new]], np.r_[values, scores[new]]
            order = np.argsort(known)
            memory.clear()
            memory[own] = known[order], values[order]
        return forward_backward(scores[which], begins, model.transitions, model.first)[0], size, text

    def label(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Each text's language and its share of the letters, and how sure its words' labels are; `und` and 0 without a letter."""
        labels = self.model.value.labels
        marginals, size, text = self.marginals(texts)
        mass = np.stack([np.bincount(text, marginals[:, j] * size, len(texts)) for j in range(len(labels))], axis=1)
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        score = np.where(total > 0, mass[np.arange(len(texts)), best] / np.maximum(total, 1e-300), 0.0).clip(0, 1)
        sure = np.bincount(text, marginals.max(axis=1, initial=0) * size, len(texts)) / np.maximum(total, 1e-300)
        return [labels[b] if t > 0 else "und" for b, t in zip(best.tolist(), total.tolist())], score.tolist(), sure.tolist()

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
        texts, langs, scores, sure = [t or "" for t in texts], [], [], []
        first = size = 0
        for i, t in enumerate([*texts, None]):
            if t is None or size and size + len(t) > AT_ONCE:
                if i > first:
                    a, b, c = self.label(texts[first:i])
                    langs += a
                    scores += b
                    sure += c
                first, size = i, 0
            size += len(t or "")
        return langs, scores, sure


class _Unknown:
    """In place of a labeller where nothing could be learned."""

    def __call__(self, texts: list) -> tuple[list[str], list[float], list[float]]:
        return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)


def _labeller(df: DataFrame, model: Model | None):
    return Labeller(df.sparkSession.sparkContext.broadcast(model)) if model else _Unknown()


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id, lang_pred and score.

    lang_pred is a language of the model, or `und` (score 0) where the text is null or has no letter, or without a model;
    score is the language's share of the letters by the words' distributions. Ties go to the first language by name.
    Repeated rows and null ids stay; other columns are ignored.
    """
    labeller = _labeller(df, model)
    schema = T.StructType([field(df, id_col), *T.StructType.fromDDL("lang_pred string, score double").fields])
    return per_block(df, {"id": f"`{id_col}`", "text": f"`{text_col}`"}, lambda columns: [columns[0], *labeller(columns[1])[:2]], schema)


def label_words(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: id and words, an array of (word, lang, p) in the order of the text."""
    labeller = _labeller(df, model)

    def block(columns):
        texts = [t or "" for t in columns[1]]
        marginals, _, text = labeller.marginals(texts)
        best, names = marginals.argmax(axis=1), labeller.model.value.labels
        out, at = [], 0
        for t, n in zip(texts, np.bincount(text, minlength=len(texts)).tolist()):
            out.append([{"word": w, "lang": names[best[at + j]], "p": float(marginals[at + j, best[at + j]])} for j, w in zip(range(n), WORD.findall(t))])
            at += n
        return [columns[0], out]

    words = T.ArrayType(T.StructType.fromDDL("word string, lang string, p double"))
    return per_block(df, {"id": f"`{id_col}`", "text": f"`{text_col}`"}, block, T.StructType([field(df, id_col), T.StructField("words", words)]))


def keep_known(df: DataFrame, model: Model | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """df's rows whose words are of known languages; all columns stay. Without a model all rows stay.

    A row goes if its text is null or has no letter, or if its words' labels are on average (by letters) less sure than
    `least`; how many languages share a text doesn't matter, so code-switched text stays.
    """
    if model is None:
        return df
    labeller = _labeller(df, model)

    def keep(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        langs, _, sure = labeller(texts)
        return rows.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, sure)], pa.bool_()))

    return edit_rows(df, text_col, keep)


def held_out(id_col: str = "doc_id"):
    """The contract's test rows: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def digest_columns(df: DataFrame) -> DataFrame:
    """The contract's columns: every row of df, labelled by a model of the rows that aren't held out."""
    model = fit(df.where(~held_out()))
    return identify(df, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
