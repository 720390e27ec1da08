import numpy as np
import pyarrow as pa
import pytest

from plateflow.llm import common as C
from plateflow.llm import decontaminate, language_id


def thue_morse(order):
    a, b = "a", "b"
    for _ in range(order):
        a, b = a + b, b + a
    return a, b


def test_names_tell_words_apart():
    """Words of every length, such that differ in one byte, and such that any polynomial modulo 2 ** 64 takes for equal."""
    rng = np.random.default_rng(1)
    words = {bytes(rng.integers(97, 99, n, np.uint8)) for n in range(1, 200) for _ in range(20)} | {x.encode() for k in range(4, 13) for x in thue_morse(k)}
    words |= {w[:i] + b"z" + w[i + 1 :] for w in list(words)[:200] for i in range(0, len(w), 7)}
    words = sorted(words)
    data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    starts, ends, names = C.stretches(data, data == 32)
    assert [data[a:b].tobytes() for a, b in zip(starts, ends)] == words and len(set(names.tolist())) == len(words)
    again = np.frombuffer(b" ".join([*words[::-1], b""]), np.uint8)
    assert C.stretches(again, again == 32)[2].tolist() == names.tolist()[::-1]  # a name doesn't depend on the place


def test_equal_stretches():
    words = [b"", b"a", b"abcdefgh", b"abcdefghi", b"x" * 64, b"x" * 65, b"x" * 64 + b"y", b"x" * 300]
    a = np.frombuffer(b"".join(words), np.uint8)
    starts = np.cumsum([0, *map(len, words[:-1])])
    for i, x in enumerate(words):
        for j, y in enumerate(words):
            if len(x) == len(y):
                got = C.equal_stretches(a, starts[i : i + 1], a, starts[j : j + 1], np.array([len(x)]))
                assert got.tolist() == [x == y]


@pytest.mark.parametrize("order", [10, 11])
def test_operators_tell_such_words_apart(order):
    a, b = thue_morse(order)
    codes, _ = decontaminate.token_codes([a, b])
    assert len(set(codes.tolist())) == 2
    codes, *_ = language_id.words_of([f"{a} {b}"])
    assert len(codes) == 2


def test_blocks_are_bounded(monkeypatch):
    """Blocks hold so many bytes, or one row; rows stay whole and in order, with nulls."""
    monkeypatch.setattr(C, "BLOCK_CHARS", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["abc", None, "d" * 50, "", "efghij", "klm", "nopqr"])], names=["id", "text"])
    blocks = list(C.sliced([batch, batch.slice(0, 0)], 1))
    assert [b.column(0).to_pylist() for b in blocks] == [[0, 1], [2], [3, 4, 5], [6]]


def test_memory_ends_with_an_operator():
    C.remembered("one")["x"] = 1
    C.release("one")
    assert C.remembered("one") == {"x": 1}
    C.release("two")
    assert C.remembered("one") == {}
