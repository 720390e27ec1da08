"""Secret scans over a trigram inverted index.

Each rule's regular expression is parsed into a Boolean query over trigrams. Texts are indexed by their own trigrams, a
block of documents at a time: postings are the sorted (trigram, document) pairs of the block. A rule's query intersects
and unites postings, and only the candidates are verified with the expression. A rule without mandatory trigrams scans
every document. The index of a block lives and dies with the block, so nothing is shuffled and memory is bounded by it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import edit_rows, field, per_block

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # Python < 3.11
    import sre_constants as sre
    import sre_parse

#: More alternatives than this are not spelled out: the query then says less, and never too much.
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: a regular expression; least: characters that `group` must have; mask: the group to redact."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    mask: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The contract's rules, in its order.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Further public formats.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?"),
    Rule("git_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("maps_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{20,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (anything may match), a trigram, or ("and" | "or", (queries...)).


@lru_cache(256)
def trigram_query(rule: Rule):
    """The Boolean trigram query that every text with a match of the rule satisfies; trigrams are in lower case."""
    return _Derive().whole(sre_parse.parse(rule.pattern, rule.compiled().flags))


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


#: Capitals to small letters, byte by byte; the rules' case is that of ASCII.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TrigramIndex:
    """Postings of a block of texts: for each trigram of their UTF-8 bytes, in lower case, the texts that have it."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = _LOWER[np.frombuffer(b"".join(raw), np.uint8)].astype(np.uint64)
        size = np.array([len(r) for r in raw], np.int64)
        self.all = np.arange(len(texts))
        if len(data) < 3:
            self.pairs = np.zeros(0, np.uint64)
            return
        text = np.repeat(self.all, size)
        codes = (data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) << np.uint64(32) | text[:-2].astype(np.uint64)
        codes = np.sort(codes[text[:-2] == text[2:]])
        self.pairs = codes[np.r_[True, codes[1:] != codes[:-1]]] if len(codes) else codes

    def postings(self, trigram: str) -> np.ndarray:
        """The texts that have a trigram, in order."""
        code = int.from_bytes(trigram.encode(), "big") << 32
        low, high = np.searchsorted(self.pairs, np.array([code, code + (1 << 32)], np.uint64))
        return (self.pairs[low:high] & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def candidates(self, query) -> np.ndarray:
        """The texts that satisfy a query, in order. A trigram that isn't ASCII tells nothing."""
        if query is True or isinstance(query, str) and not query.isascii():
            return self.all
        if isinstance(query, str):
            return self.postings(query)
        parts = sorted((self.candidates(q) for q in query[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def _join(kind: str, queries) -> object:
    """And or or, without what is constant or said twice."""
    found = []
    for q in queries:
        if q is True:
            if kind == "or":
                return True
        elif q not in found:
            found.append(q)
    if kind == "or":  # a part that says more than another part adds nothing
        said = [frozenset(q[1]) if q[0] == "and" else frozenset([q]) for q in found]
        found = [q for q, x in zip(found, said) if not any(y < x for y in said)]
    return True if not found else found[0] if len(found) == 1 else (kind, tuple(found))


class _Derive:
    def whole(self, items) -> object:
        strings, queries = self.sequence(items)
        return _join("and", [*queries, self.of_strings(strings)])

    @staticmethod
    def of_strings(strings: set[str]) -> object:
        """One of the strings occurs."""
        return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])

    def sequence(self, items) -> tuple[set[str], list]:
        """The strings that its last stretch can be, and queries for what stands before."""
        run, queries = {""}, []
        for item in items:
            strings, query, open_end = self.one(item)
            if strings is not None and len(run) * len(strings) <= MAX_STRINGS:
                run = {a + b for a, b in product(run, strings)}
                if not open_end:
                    continue
                strings = {""}
            queries += [self.of_strings(run), query]
            run = strings if strings is not None and not open_end else {""}
        return run, queries

    def one(self, item) -> tuple[set[str] | None, object, bool]:
        """Its strings if they are few, a query, and whether more of unknown content follows its strings."""
        op, arg = item
        if op is sre.LITERAL:
            return {chr(arg).lower()}, True, False
        if op is sre.IN:
            few = set()
            for kind, x in arg:
                if kind is sre.LITERAL:
                    few.add(chr(x).lower())
                elif kind is sre.RANGE and x[1] - x[0] < 5:
                    few |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, True, False
            return (few, True, False) if len(few) <= 5 else (None, True, False)
        if op is sre.SUBPATTERN:
            return self.group(arg[-1])
        if op is sre.BRANCH:
            parts = [self.group(x) for x in arg[1]]
            if all(s is not None and not more for s, _, more in parts) and len(union := set().union(*(p[0] for p in parts))) <= MAX_STRINGS:
                return union, True, False
            return None, _join("or", [self.whole(x) for x in arg[1]]), False
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) or op is getattr(sre, "POSSESSIVE_REPEAT", None):
            least, most, body = arg
            strings, query, more = self.group(body)
            if least == 0:
                return (strings | {""}, True, False) if most == 1 and strings is not None and not more else (None, True, False)
            return strings, query, more or most > 1
        if op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            return {""}, True, False
        return None, True, False

    def group(self, items) -> tuple[set[str] | None, object, bool]:
        strings, queries = self.sequence(items)
        return (strings, True, False) if not [q for q in queries if q is not True] and self.closed(items) else (None, self.whole(items), False)

    def closed(self, items) -> bool:
        """Every item has a few strings, so the last stretch is all there is."""
        n = 1
        for item in items:
            strings, query, more = self.one(item)
            if strings is None or more or (n := n * len(strings)) > MAX_STRINGS:
                return False
        return True


def find_spans(texts: list[str], rules: tuple[Rule, ...]) -> list[list[tuple[int, int, int, int, int]]]:
    """For each text its matches (start, rule's place, end, mask's start, mask's end), sorted."""
    index, found = TrigramIndex(texts), [[] for _ in texts]
    for k, rule in enumerate(rules):
        # a bare class repeated: runs that are too short need not become matches
        fast = re.compile(f"{rule.pattern[:-1]}{{{rule.least},}}", re.ASCII) if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) and not rule.group and not rule.ignore_case else None
        expression = fast or rule.compiled()
        for i in index.candidates(trigram_query(rule)).tolist():
            for m in expression.finditer(texts[i]):
                if len(m[rule.group]) >= rule.least:
                    found[i].append((m.start(), k, m.end(), *m.span(rule.mask)))
    for x in found:
        x.sort()
    return found


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each row of df: its id and `found`, an array of (kind, start, end, mask_start, mask_end).

    Positions are code points, ends exclusive, sorted by start, then by the rules' order. Matches of a rule are leftmost
    and do not overlap; those with too short a group go. A null or empty text has an empty array; repeated rows and null
    ids are kept as they are; other columns are ignored.
    """
    kinds = [r.kind for r in rules]

    def block(columns):
        ids, texts = columns
        found = find_spans([t or "" for t in texts], rules)
        return [ids, [[{"kind": kinds[k], "start": s, "end": e, "mask_start": a, "mask_end": b} for s, k, e, a, b in x] for x in found]]

    spans = T.ArrayType(T.StructType.fromDDL("kind string, start long, end long, mask_start long, mask_end long"))
    return per_block(df, {"id": f"`{id_col}`", "text": f"`{text_col}`"}, block, T.StructType([field(df, id_col), T.StructField("found", spans)]))


def redact(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """df with each secret in its text replaced by a mark; overlapping secrets become one mark.

    All columns and rows stay, in df's order of columns; chars_col (if df has it) is set anew where a text changed. Null
    texts stay null.
    """
    kinds = df.schema
    place, chars = kinds.names.index(text_col), kinds.names.index(chars_col) if chars_col in kinds.names else -1

    def each(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        new = [None if t is None else _masked(t, x, mark) for t, x in zip(texts, find_spans([t or "" for t in texts], rules))]
        columns = list(rows.columns)
        columns[place] = pa.array(new, rows.schema.field(place).type)
        if chars >= 0:
            old = columns[chars].to_pylist()
            columns[chars] = pa.array([len(n) if n is not None and n != t else o for n, t, o in zip(new, texts, old)], rows.schema.field(chars).type)
        return pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return edit_rows(df, text_col, each)


def _masked(text: str, found: list[tuple], mark: str) -> str:
    out, at = [], 0
    for start, end in sorted((a, b) for *_, a, b in found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns, from scan()'s result."""
    named = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(id_col, *[count(r.kind) for r in BASE_RULES], F.sha2(F.array_join(F.transform(base, named), ","), 256).alias("base_sha256"), F.array_join(F.transform("found", named), ",").alias("spans"))


def brute_force(text: str | None) -> dict:
    """The contract, by plain loops over the base rules; for tests."""
    found = []
    for k, r in enumerate(BASE_RULES):
        found += [(m.start(), k, m.end()) for m in re.finditer(r.pattern, text or "", re.ASCII | (re.I if r.ignore_case else 0)) if len(m[r.group]) >= r.least]
    said = ",".join(f"{BASE_RULES[k].kind}:{s}:{e}" for s, k, e in sorted(found))
    return {f"n_{r.kind}": sum(k == i for _, k, _ in found) for i, r in enumerate(BASE_RULES)} | {"base_sha256": sha256(said.encode()).hexdigest()}
