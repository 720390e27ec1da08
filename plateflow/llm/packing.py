"""Packing of tokenised documents into sequences by multiway Karmarkar-Karp differencing.

A document's ids (and an end id) are cut at the sequence length; whole sequences stand alone. What remains is one piece,
and pieces are dealt, a block of them at a time, to so many windows as their sum needs: each piece begins as a partial partition with one filled window; the two partial partitions with the largest imbalance are merged,
the fuller windows of one onto the emptier windows of the other, until one is left, whose windows are nearly equal. If
one exceeds the capacity, the number of windows rises by one and the block is dealt again. Then the emptiest windows are
taken apart to fill the others up, which are nearly full; less than a window is left over, and goes into the next block.
Blocks are bounded and made where the documents are read, so nothing is shuffled; what is left over at a partition's end
makes sequences of lengths that are powers of two, so no sequence is padded, however the documents are dealt.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import equal_stretches, field, release, remembered, sliced, stretches

#: Pieces that are dealt at once.
BLOCK_PIECES = 256
#: Strings whose ids a worker remembers at most, and the longest of them; rows of output at once.
REMEMBERED, REMEMBERED_CHARS, ROWS = 100_000, 48, 4096
#: A rank above all; a hash table's multiplier (2 ** 32 / golden ratio, odd) and bits.
NONE, MULTIPLIER, BITS = 1 << 40, 2654435769, 19


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit integers, for a word-end BPE tokenizer that drops white space.

    No token spans a space or line feed, so a text's ids are those of its stretches between them. Texts of printable
    ASCII and Latin-1 letters (PLAIN) are handled a block at a time in numpy: equal stretches are found by a 64-bit hash, which
    is verified byte for byte, and the distinct ones merged all at once by the file's own merges. The library encodes
    whatever else there is.
    """

    #: Characters whose lower case, class and normal form are plain.
    PLAIN = re.compile("[\x20-\x7e\\n\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        model = json.loads(self.tokenizer.to_str())["model"]
        vocab, pairs = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # byte-level BPE writes a byte as itself if it is printable in Latin-1 and else as the next character from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char[b] + model["end_of_word_suffix"]] for b in range(256)], np.int64)
        self.keys, self.slots = self.table([vocab[a] << 16 | vocab[b] for a, b in pairs], [(i << 16) | vocab[a + b] for i, (a, b) in enumerate(pairs)])
        none = np.zeros(0, np.int64)
        # stretches that are remembered, by hash: hash, start and number of its ids, start and number of its bytes; then all ids and bytes
        self.seen = np.zeros(0, np.uint64), none, none, none, none, np.zeros(0, "<u4"), np.zeros(0, np.uint8)

    @staticmethod
    def of(path: str) -> WordTokenizer:
        known = remembered(__name__)
        if path not in known:
            known[path] = WordTokenizer(path)
        return known[path]

    @staticmethod
    def table(keys: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """A hash table with linear probing; slots hold rank << 16 | id, NONE where there is no pair."""
        at, held = np.full(1 << BITS, -1, np.int64), np.full(1 << BITS, NONE, np.int64)
        for k, v in zip(keys, values):
            i = (k * MULTIPLIER & 0xFFFFFFFF) >> (32 - BITS)
            while at[i] >= 0 and at[i] != k:
                i = (i + 1) & ((1 << BITS) - 1)
            if at[i] < 0:
                at[i], held[i] = k, v
        return at, held

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 16 | id of each pair, or NONE."""
        key = left << 16 | right
        i = (key * MULTIPLIER & 0xFFFFFFFF) >> (32 - BITS)
        at = self.keys[i]
        out = np.where(at == key, self.slots[i], NONE)
        todo = np.flatnonzero((at != key) & (at >= 0))
        while todo.size:
            i[todo] = (i[todo] + 1) & (len(self.keys) - 1)
            at = self.keys[i[todo]]
            hit = at == key[todo]
            out[todo[hit]] = self.slots[i[todo[hit]]]
            todo = todo[~hit & (at >= 0)]
        return out

    def bpe(self, symbols: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges the pair of least rank, the leftmost first, in all pieces at once; returns symbols and their pieces, in order."""
        done_symbols, done_pieces = [], []
        while symbols.size:
            same = piece[1:] == piece[:-1]
            first = np.flatnonzero(np.r_[True, ~same])
            best = np.full(len(symbols), NONE, np.int64)
            inside = np.flatnonzero(same)
            best[inside] = self.merges(symbols[inside], symbols[inside + 1])
            least = np.repeat(np.minimum.reduceat(best, first), np.diff(np.r_[first, len(symbols)]))
            live = least < NONE
            done_symbols.append(symbols[~live])
            done_pieces.append(piece[~live])
            place = np.flatnonzero((best == least) & live)
            if place.size:
                p = piece[place]
                place = place[np.r_[True, p[1:] != p[:-1]]]
                symbols[place] = best[place] & 0xFFFF
                live[place + 1] = False
            symbols, piece = symbols[live], piece[live]
        piece = np.concatenate(done_pieces) if done_pieces else piece
        order = np.argsort(piece, kind="stable")
        return np.concatenate([symbols, *done_symbols])[order], piece[order]

    def distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches, one after the other, and how many each has."""
        counts, ids = np.zeros(len(starts), np.int64), []
        for i in range(0, len(starts), 8192):
            size = ends[i : i + 8192] - starts[i : i + 8192]
            owner = np.repeat(np.arange(len(size)), size)
            b = data[np.repeat(starts[i : i + 8192] - (np.cumsum(size) - size), size) + np.arange(len(owner))]
            odd = np.zeros(len(size), bool)
            odd[owner[b == 39]] = True  # an apostrophe may begin a piece of its own kind, and <| a special token
            odd[owner[:-1][(b[:-1] == 60) & (b[1:] == 124)]] = True
            wide = b >= 128
            kind = np.where(wide | (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122), 1, np.where((b >= 48) & (b <= 57), 2, 3))
            b = b + np.where((b >= 65) & (b <= 90) | (b >= 128) & (b <= 158), 32, 0).astype(np.uint8)  # a capital, or its second byte
            new = np.r_[True, (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == 2)]
            symbols = self.inner[b]
            tail = np.r_[new[1:], True]
            symbols[tail] = self.last[b[tail]]
            symbols, piece = self.bpe(symbols, np.cumsum(new) - 1)
            owner = owner[new][piece]
            if odd.any():
                keep = ~odd[owner]
                symbols, owner = symbols[keep], owner[keep]
                for j in np.flatnonzero(odd).tolist():
                    more = self.tokenizer.encode(data[starts[i + j] : ends[i + j]].tobytes().decode(), add_special_tokens=False).ids
                    symbols, owner = np.r_[symbols, np.array(more, np.int64)], np.r_[owner, np.full(len(more), j)]
                order = np.argsort(owner, kind="stable")
                symbols, owner = symbols[order], owner[order]
            counts[i : i + 8192] = np.bincount(owner, minlength=len(size))
            ids.append(symbols.astype("<u4"))
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), counts

    def plain(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        gap = (data == 32) | (data == 10)
        starts, ends, codes = stretches(data, gap)
        if not len(starts):
            return [b""] * len(texts)
        codes, place, which = np.unique(codes, return_index=True, return_inverse=True)
        seen, begin, count, byte, length, pool, said = self.seen
        own, size = starts[place], (ends - starts)[place]
        if (size[which] != ends - starts).any() or not equal_stretches(data, starts, data, own[which], ends - starts).all():
            return [self.library(t) for t in texts]  # stretches that differ have one hash
        at = np.minimum(np.searchsorted(seen, codes), max(len(seen) - 1, 0))
        old = np.zeros(len(codes), bool)
        if len(seen):
            some = np.flatnonzero((seen[at] == codes) & (length[at] == size))
            old[some] = equal_stretches(data, own[some], said, byte[at[some]], size[some])
        fresh = np.flatnonzero(~old)
        ids, counts = self.distinct(data, own[fresh], own[fresh] + size[fresh])
        begins, sizes = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        begins[old], sizes[old] = begin[at[old]], count[at[old]]
        begins[fresh], sizes[fresh] = len(pool) + np.cumsum(counts) - counts, counts
        pool = np.concatenate([pool, ids])
        keep = fresh[size[fresh] <= REMEMBERED_CHARS]
        if len(seen) + len(keep) <= REMEMBERED:
            n = size[keep]
            more = data[np.repeat(own[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            seen = np.concatenate([seen, codes[keep]])
            order = np.argsort(seen)
            columns = ([begin, begins[keep]], [count, sizes[keep]], [byte, len(said) + np.cumsum(n) - n], [length, n])
            self.seen = seen[order], *(np.concatenate(c)[order] for c in columns), pool, np.concatenate([said, more])
        n = sizes[which]
        total = np.cumsum(n)
        out = pool[np.repeat(begins[which] - (total - n), n) + np.arange(total[-1])].tobytes()
        limits = np.cumsum([len(r) + 1 for r in raw])
        cuts = np.r_[0, total][np.searchsorted(starts, np.r_[0, limits])] * 4
        return [out[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]

    def encode(self, texts: list[str]) -> list[bytes]:
        easy = [bool(self.PLAIN.fullmatch(t)) for t in texts]
        done = iter(self.plain([t for t, e in zip(texts, easy) if e]))
        return [next(done) if e else self.library(t) for t, e in zip(texts, easy)]

    def library(self, text: str) -> bytes:
        words = text.replace("\n", " ").split(" ")
        if len(self.known) > REMEMBERED:
            self.known = {"": b""}
        new = list({w for w in words if w not in self.known})
        ids = dict(zip(new, (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False))))
        out = b"".join([self.known[w] if w in self.known else ids[w] for w in words])
        if len(self.known) + len(ids) <= REMEMBERED:
            self.known.update((w, b) for w, b in ids.items() if len(w) <= REMEMBERED_CHARS)
        return out


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items to k windows with nearly equal sums; returns each window's items, in their order."""
    none = -1
    parts, left, right = [], [], []  # joined sets of items are nodes len(sizes) + i = left[i] with right[i]
    for i, s in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.full(k, none, np.int64)
        sums[-1], nodes[-1] = s, i
        parts.append((-s if k > 1 else 0, i, sums, nodes))
    heapq.heapify(parts)
    serial = len(sizes)
    while len(parts) > 1:
        _, _, a, x = heapq.heappop(parts)
        _, _, b, y = heapq.heappop(parts)
        sums, y = a + b[::-1], y[::-1]
        nodes = np.where(x == none, y, x)
        if (both := np.flatnonzero((x != none) & (y != none))).size:
            nodes[both] = len(sizes) + len(left) + np.arange(both.size)
            left += x[both].tolist()
            right += y[both].tolist()
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(parts, (-int(sums[-1] - sums[0]), serial, sums, nodes))
        serial += 1
    windows = []
    for top in parts[0][3].tolist() if parts else []:
        items, stack = [], [top] if top != none else []
        while stack:
            n = stack.pop()
            if n < len(sizes):
                items.append(n)
            else:
                stack += [left[n - len(sizes)], right[n - len(sizes)]]
        windows.append(sorted(items))
    return windows


def deal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows within the capacity; their number rises from the least possible one until none exceeds it."""
    k = -(-sum(sizes) // capacity)
    while True:
        windows = karmarkar_karp(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        k += 1


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: id, start, doc_tokens, sequence_id, offset, length and ids (binary, little-endian, unsigned 32 bits).

    Each id of a document, and its end id, lies in exactly one piece; pieces fill a sequence from offset 0 without gaps,
    up to its capacity. A null or empty text has its end id alone. Rows of equal ids (null ones too) are documents of
    their own; other columns are ignored. Sequences are full, but for less than one at the end of each partition, which is
    cut into lengths that are powers of two. sequence_id is unique, not dense.
    """
    schema = T.StructType([field(df, id_col)] + T.StructType.fromDDL("start long, doc_tokens long, sequence_id long, offset long, length long, ids binary").fields)
    return df.select(id_col, text_col).mapInArrow(_Packer(tokenizer, capacity, end_id, schema), schema)


class _Packer:
    def __init__(self, tokenizer: str, capacity: int, end_id: int, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.tokenizer, self.capacity, self.end, self.schema = tokenizer, capacity, np.array([end_id], "<u4").tobytes(), to_arrow_schema(schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(__name__)
        context = TaskContext.get()
        self.next = (context.partitionId() if context else 0) << 32
        self.rows: list[tuple] = []
        pieces: list[tuple] = []  # (document, start, document's ids, ids)
        size = 4 * self.capacity
        for doc, ids in self.documents(batches):
            n = len(ids) // 4
            whole = len(ids) - len(ids) % size
            for at in range(0, whole, size):
                self.sequence([(doc, at // 4, n, ids[at : at + size])])
            if whole < len(ids):
                pieces.append((doc, whole // 4, n, ids[whole:]))
            if len(pieces) >= BLOCK_PIECES:
                pieces = self.block(pieces)
            if len(self.rows) >= ROWS:
                yield self.batch()
        rest = self.block(pieces)
        while rest:
            total = sum(len(p[3]) for p in rest) // 4
            self.sequence(_cut(rest, 1 << (total.bit_length() - 1)))
        if self.rows:
            yield self.batch()
        release(__name__)

    def documents(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        encode = WordTokenizer.of(self.tokenizer).encode
        for block in sliced(batches, 1):
            docs, texts = block.column(0).to_pylist(), [t or "" for t in block.column(1).to_pylist()]
            yield from ((d, ids + self.end) for d, ids in zip(docs, encode(texts)))

    def sequence(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, n, ids in pieces:
            self.rows.append((doc, start, n, self.next, offset, len(ids) // 4, ids))
            offset += len(ids) // 4
        self.next += 1

    def block(self, pieces: list[tuple]) -> list[tuple]:
        """Deals the pieces to windows and makes a sequence of each that can be filled; returns the pieces of what is left."""
        sizes = [len(p[3]) // 4 for p in pieces]
        windows = deal(sizes, self.capacity) if sizes else []
        total = [sum(sizes[i] for i in w) for w in windows]
        order = sorted(range(len(windows)), key=lambda i: -total[i])
        full = sum(sizes) // self.capacity
        rest = [pieces[i] for w in order[full:] for i in windows[w]]
        for w in order[:full]:
            room = [pieces[i] for i in windows[w]]
            self.sequence(room + _cut(rest, self.capacity - total[w]))
        return rest

    def batch(self) -> pa.RecordBatch:
        columns, self.rows = list(zip(*self.rows)), []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)


def _cut(pieces: list[tuple], want: int) -> list[tuple]:
    """Takes so many ids off the end of the pieces; the piece where it ends is cut in two."""
    out = []
    while want:
        doc, start, n, ids = pieces.pop()
        if len(ids) > 4 * want:
            pieces.append((doc, start, n, ids[: len(ids) - 4 * want]))
            start, ids = start + len(ids) // 4 - want, ids[len(ids) - 4 * want :]
        out.append((doc, start, n, ids))
        want -= len(ids) // 4
    return out
