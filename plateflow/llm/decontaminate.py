"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over neighbouring tokens whose zeros are positions that don't count. Each mask's selected tokens are
hashed at every position of the test items and of the documents; equal hashes are hits, and around each hit the two texts
are compared token by token on the hit's diagonal, where some tokens may be replaced. The test items' hashes are sent to
the documents (which aren't shuffled) in slices of at most SLICE_TOKENS tokens; a larger test set takes more slices, each
with a pass of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import edit_rows, field, mixed, per_block, stretches

#: The zeros may be replaced in a text. Any 13 to 25 tokens of which AGREE or more agree hold a place where one of the masks
#: fits; a longer stretch splits into such lengths, one of which has that share too, so no overlap is without a seed.
MASKS = ("1111111", "11101111", "11110111", "1110100111", "1101001000111", "111100010011", "10100110111")
#: Tokens of a verified overlap, and the share of them that must agree. An item of fewer tokens is found verbatim, as a whole.
OVERLAP, AGREE = 13, 0.8
#: Tokens of test items that are broadcast at once, most bits of the tables that rule most hashes out, hits that are held at once.
SLICE_TOKENS, TABLE_BITS, AT_ONCE = 1_000_000, 22, 1 << 20

TOKEN = re.compile(r"[^\W_]+")
#: Text (lower-cased) in which exactly the ASCII characters that aren't letters or digits separate tokens.
PLAIN = re.compile("[\x00-\x7fß-öø-ÿ]*")
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def lowered(text: str) -> str:
    """Lower case, code point by code point, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def token_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each token of the texts, and where each text's tokens begin (with the end at last)."""
    low = [lowered(t) for t in texts]
    raw = [(t if PLAIN.fullmatch(t) else " ".join(TOKEN.findall(t))).encode() for t in low]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    starts, _, codes = stretches(data, ~_WORDLIKE[data])
    return codes, np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))


def seed_hashes(codes: np.ndarray, mask: str) -> np.ndarray:
    """The hash of the selected tokens at each place where the mask fits."""
    n = len(codes) - len(mask) + 1
    total = np.full(max(n, 0), int(mask, 2) * len(mask), np.uint64)
    for k in [i for i, x in enumerate(mask) if x == "1"] if n > 0 else []:
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    return mixed(total)


@dataclass
class Seeds:
    """A slice of the test set: items' tokens, and their seeds, sorted by hash."""

    ids: list
    codes: np.ndarray
    begin: np.ndarray
    masks: list[str]
    hashes: list[np.ndarray]
    places: list[np.ndarray]
    tables: list[np.ndarray]
    bits: int

    @staticmethod
    def of(ids: list, texts: list[str], shortest: int = 1) -> Seeds:
        codes, begin = token_codes(texts)
        sizes = np.diff(begin)
        item = np.repeat(np.arange(len(ids)), sizes)
        short = sorted({int(n) for n in sizes if shortest <= n < OVERLAP})
        bits = min(TABLE_BITS, max(12, 4 + len(codes).bit_length()))
        seeds = Seeds(ids, codes, begin, [*MASKS, *("1" * n for n in short)], [], [], [], bits)
        for k, mask in enumerate(seeds.masks):
            hashes = seed_hashes(codes, mask)
            at = np.arange(len(hashes))
            own = item[at] == item[at + len(mask) - 1] if len(at) else np.zeros(0, bool)
            # long items by the masks, short ones by the mask of their own length, at their beginning
            fits = own & (sizes[item[at]] >= OVERLAP if k < len(MASKS) else sizes[item[at]] == len(mask))
            hashes, at = hashes[fits], at[fits]
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << bits, bool)
            table[hashes >> np.uint64(64 - bits)] = True
            seeds.hashes.append(hashes[order])
            seeds.places.append(at[order])
            seeds.tables.append(table)
        return seeds

    def hits(self, codes: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Distinct (text, item, diagonal) of the texts' seeds that equal a test seed of the same mask."""
        item_of = np.repeat(np.arange(len(self.ids)), np.diff(self.begin))
        text_of = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        found, held = [np.zeros((0, 3), np.int64)], 0
        for mask, hashes, places, table in zip(self.masks, self.hashes, self.places, self.tables):
            if not len(hashes):
                continue
            own = seed_hashes(codes, mask)
            at = np.flatnonzero(table[own >> np.uint64(64 - self.bits)])
            at = at[text_of[at] == text_of[at + len(mask) - 1]]
            low = np.searchsorted(hashes, own[at], "left")
            n = np.searchsorted(hashes, own[at], "right") - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            # a seed that is frequent in the texts and in the items has as many hits as both together: some at a time
            while len(at):
                part = max(1, int(np.searchsorted(np.cumsum(n), AT_ONCE, "right")))
                here, first, times = at[:part], low[:part], n[:part]
                for i in range(0, int(times.max()), AT_ONCE):
                    few = np.clip(times - i, 0, AT_ONCE)
                    place = places[np.repeat(first + i - (np.cumsum(few) - few), few) + np.arange(few.sum())]
                    text = np.repeat(here, few)
                    found.append(np.stack([text_of[text], item_of[place], (text - begin[text_of[text]]) - (place - self.begin[item_of[place]])], axis=1))
                    held += len(place)
                    if held > AT_ONCE:
                        found, held = [np.unique(np.concatenate(found), axis=0)], 0
                at, low, n = at[part:], low[part:], n[part:]
        return np.unique(np.concatenate(found), axis=0)


def overlaps(text: np.ndarray, item: np.ndarray, diagonal: int) -> list[tuple[int, int, int]]:
    """Verified overlaps on a diagonal: (start in text, tokens, agreeing tokens).

    An overlap begins and ends with agreeing tokens, has OVERLAP tokens or more, of which AGREE or more agree, and reaches
    from the first token that begins one as far as it can. An item of fewer tokens must agree as a whole.
    """
    low, high = max(0, diagonal), min(len(text), len(item) + diagonal)
    same = text[low:high] == item[low - diagonal : high - diagonal]
    if len(item) < OVERLAP:
        return [(low, len(item), len(item))] if len(same) == len(item) and same.all() else []
    if same.sum() < AGREE * OVERLAP:
        return []
    # a stretch has enough agreeing tokens if its sum isn't negative, where each counts 1 - AGREE and each other one -AGREE
    sums = np.r_[0, np.cumsum(np.where(same, 100 - round(100 * AGREE), -round(100 * AGREE)))]
    best_from = np.maximum.accumulate(sums[::-1])[::-1]  # falls
    out, i = [], 0
    for start in np.flatnonzero(same).tolist():
        if start >= i:
            end = int(np.searchsorted(-best_from, -sums[start], side="right")) - 1  # the last place that isn't lower
            if end - start >= OVERLAP:
                out.append((low + start, end - start, int(same[start:end].sum())))
                i = end
    return out


def find(texts: list[str], seeds: Seeds) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(text, item, overlaps) of the texts that have any, by text and item."""
    codes, begin = token_codes(texts)
    out: dict[tuple[int, int], set] = {}
    for t, i, d in seeds.hits(codes, begin).tolist():
        if got := overlaps(codes[begin[t] : begin[t + 1]], seeds.codes[seeds.begin[i] : seeds.begin[i + 1]], d):
            out.setdefault((t, i), set()).update(got)
    return [(t, i, sorted(x)) for (t, i), x in sorted(out.items())]


def _slices(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The test set, at most about SLICE_TOKENS tokens at a time; the driver holds one slice."""
    held, size = [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        held.append((row[0], row[1] or ""))
        size += len(held[-1][1]) // 4
        if size >= SLICE_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shortest: int = 1) -> DataFrame:
    """One row for each row of df and test item that share a verified overlap.

    Returns id, item id, item_tokens, tokens and agreeing (of the longest overlap) and spans: every overlap's (start, end)
    in code points of the text. Tokens are runs of letters and digits, in lower case. Items of fewer than OVERLAP tokens are
    found verbatim, those of fewer than `shortest` not at all; null texts have no tokens, and items without one are never
    found; repeated rows and items each have their rows; null ids are kept; empty tables give an empty result.
    """
    spark = df.sparkSession
    schema = T.StructType([field(df, id_col), field(benchmark, item_col), *T.StructType.fromDDL("item_tokens long, tokens long, agreeing long, spans array<struct<start: long, end: long>>").fields])
    results = []
    for part in _slices(benchmark, item_col, item_text_col):
        seeds = spark.sparkContext.broadcast(Seeds.of(*map(list, zip(*part)), shortest))
        results.append(per_block(df, {"id": f"`{id_col}`", "text": f"`{text_col}`"}, _Finder(seeds), schema))
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


class _Finder:
    def __init__(self, seeds):
        self.seeds = seeds

    def __call__(self, columns: list[list]) -> list[list]:
        ids, texts = columns[0], [t or "" for t in columns[1]]
        seeds = self.seeds.value
        out = [[], [], [], [], [], []]
        for k, item, got in find(texts, seeds):
            places = [m.span() for m in TOKEN.finditer(lowered(texts[k]))]
            best = max(got, key=lambda x: (x[1], x[2], -x[0]))
            spans = [{"start": places[s][0], "end": places[s + n - 1][1]} for s, n, _ in got]
            for column, x in zip(out, (ids[k], seeds.ids[item], int(seeds.begin[item + 1] - seeds.begin[item]), best[1], best[2], spans)):
                column.append(x)
        return out


def decontaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", shortest: int = 5) -> DataFrame:
    """df's rows without a verified overlap with a test item; all columns stay. One pass for each slice of the test set.

    Items of fewer than `shortest` tokens (a single common word, say) make no row go: they can't be told from chance.
    """
    for part in _slices(benchmark, item_text_col, item_text_col):
        seeds = df.sparkSession.sparkContext.broadcast(Seeds.of(*map(list, zip(*part)), shortest))

        def clean(rows: pa.RecordBatch, texts: list, seeds=seeds) -> pa.RecordBatch:
            found = np.zeros(len(texts), bool)
            found[[k for k, _, _ in find([t or "" for t in texts], seeds.value)]] = True
            return rows.filter(pa.array(~found))

        df = edit_rows(df, text_col, clean)
    return df


def brute_force(text: str | None, item: str | None) -> bool:
    """Whether any diagonal has a verified overlap; for tests."""
    a, b = (TOKEN.findall(lowered(x or "")) for x in (text, item))
    if not a or not b:
        return False
    codes = {w: i for i, w in enumerate({*a, *b})}
    x, y = np.array([codes[w] for w in a]), np.array([codes[w] for w in b])
    # all pairs of places with one token; a diagonal with too few of them has no overlap
    at, place = np.nonzero(x[:, None] == y[None, :])
    diagonals, agreeing = np.unique(at - place, return_counts=True)
    return any(overlaps(x, y, int(d)) for d in diagonals[agreeing >= (AGREE * OVERLAP if len(b) >= OVERLAP else len(b))])
