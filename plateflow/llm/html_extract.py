"""Main text of web pages by union-free wrappers of their hosts.

A page becomes a stream of tokens: block elements that open and close, and stretches of text (inline markup is looked
through). The streams of one host are aligned one after the other: an element that comes again among its siblings turns
the stretch from its first to its last appearance into a repeated group, an element that one side lacks becomes optional,
and a text becomes a slot of its element that remembers whether it was ever different. The result is a regular expression
without unions, in which each element has one place, so a host's wrapper is as large as its template and not as its pages.
Wrappers are made where pages are read, a part of the pages at a time, and merged in two steps, so no host is gathered.

A page is matched with its host's wrapper, whose places decide: a slot is main text unless it lies in an element that is not
part of articles (by its name, role, class or id), or outside of the host's articles where there are any. Outside of articles
repeated groups that are mostly links on the host as a whole are lists of links and go with all that is in them, and so do
single slots that are; a slot that every page has and that is always the same is of the template, and so are texts that
nearly every page of a host says; these are counted exactly, over all pages. What matches no place of the wrapper is no text.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage
from .common import field as column

# Fixed values of the HTML standard: elements that hold raw text, that are no text, that break blocks, that are empty.
RAW = "script style textarea title xmp iframe noembed noframes noscript template svg math select"
SILENT = "head script style textarea title iframe noembed noframes noscript template svg math select button form nav footer aside dialog object audio video canvas map menu datalist input label legend fieldset".split()
BLOCKS = frozenset(
    "html body address article aside blockquote button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr legend li main map menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul video audio object iframe noscript template script style textarea title svg math noembed noframes xmp".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Opening one of these ends an open element of the second kind, up to an element of the third.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements of tables that other closing tags don't reach out of, and those whose closing tags do.
CELLS, IN_TABLES = ("td", "th", "table"), frozenset("table tr tbody thead tfoot td th body html".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}

#: Words in a class, id or role that tell what an element is; `header` and `banner` tell it outside of articles alone.
KINDS = {
    "advert": "ad ads advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promoted promotion",
    "comments": "comment comments commentlist commentarea disqus respond replies discussion",
    "notice": "cookie cookies consent gdpr notice notices banner alert alertdialog popup modal overlay dialog newsletter subscribe subscription signup paywall toast announcement",
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs pagination pager toolbar tabs sitemap skiplink",
    "side": "sidebar aside complementary widget widgets related recommended recommendations trending share sharing social",
    "foot": "footer contentinfo copyright colophon",
    "head": "header masthead topbar",
    "hidden": "hidden sr-only visually-hidden screen-reader-text",
}
_KIND_OF = {w: k for k, words in KINDS.items() for w in words.split()}
#: First parts of a class that tell what an element has or lacks, and parts that make a header the article's own.
NEGATED, OWN = frozenset("has have with no not without hide js is".split()), frozenset("post entry article content story title".split())
ARTICLE = frozenset("article main".split())

#: Elements within each other that a wrapper holds, at most; of deeper ones only those that begin an article, or that are of
#: none, are noted, once each, and the texts of all others count to that depth. Different pages from which a host's template is known, the share of
#: its pages that say a text of that, and the share of links that makes a slot one of links.
DEPTH, PAGES, TEMPLATE, LINKS = 48, 3, 0.8, 0.7
#: Bytes of all hosts' slots up to which they are sent to where the pages are read; beyond, pages are dealt by hosts.
BROADCAST_BYTES = 64_000_000

_TOKEN = re.compile(
    rf"""<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<raw>{'|'.join(RAW.split())})\b(?P<rawattrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>(?P<body>.*?)(?:</(?P=raw)\s*[^>]*(?:>|\Z)|\Z)
    |<(?P<close>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    |<(?P<close2>/?)(?P<name2>[a-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)
    |(?P<text>[^<]+|<)""",
    re.S | re.I | re.X,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|$)""", re.I)
_WORDS = re.compile(r"[a-z]+(?:-[a-z]+)*")
_SPACE = re.compile(r"\s+")


def label(name: str, attributes: str) -> str:
    """The element's name and, behind a colon, the kind that its attributes tell."""
    if not attributes or attributes.isspace():
        return name
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return f"{name}:hidden"
        if key == "role" and value == "main":
            return f"{name}:main"
        if key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog"):
            return f"{name}:{_KIND_OF.get(value, 'menu')}"
        if key in ("class", "id"):
            for word in value.replace("_", "-").split():
                parts = [p for x in _WORDS.findall(word) for p in x.split("-")]
                if parts and parts[0] in NEGATED:
                    continue
                for w in (*_WORDS.findall(word), *parts):
                    if (kind := _KIND_OF.get(w)) and not (kind == "head" and OWN & set(parts)):
                        return f"{name}:{kind}"
    return name


def stream(html: str | None) -> list[tuple[int, str, int]]:
    """The page's tokens: (1, label, 0) opens a block element, (-1, label, 0) closes it, (0, text, letters in links) is a text.

    References are decoded, white space is one space, and no text is empty. Below DEPTH elements, one opens only if it is the
    first there to begin an article or to be of none; all are closed by their own tags. Closing tags that nothing opened are ignored,
    and what is left open is closed where its parent is, or where the standard implies it.
    """
    out: list[tuple[int, str, int]] = []
    names: list[str] = []  # of all open elements
    labels: list[str | None] = []  # theirs, or nothing for one that isn't noted
    places: dict[str, list[int]] = {}  # of the open elements of each name
    noted = [(False, False)]  # of each open element that is noted: whether it lies in an article, and in an element of none
    held: list[str] = []
    link = linked = 0

    def flush():
        nonlocal linked
        if held:
            said = _SPACE.sub(" ", unescape("".join(held))).strip()
            if said:
                out.append((0, said, min(linked, len(said))))
            held.clear()
        linked = 0

    def close_to(depth: int):
        while len(names) > depth:
            places[names.pop()].pop()
            if (tag := labels.pop()) is not None:
                noted.pop()
                out.append((-1, tag, 0))

    def last(of) -> int:
        return max((places[n][-1] for n in of if places.get(n)), default=-1)

    for m in _TOKEN.finditer(html or ""):
        if (text := m["text"]) is not None:
            held.append(text)
            linked += len(text) if link else 0
            continue
        if m["raw"]:
            if m["raw"].lower() in BLOCKS:
                flush()
            continue
        name, closing = m["name"] or m["name2"], m["close"] or m["close2"]
        if not name:
            continue
        name = name.lower()
        if name == "a":
            link = 0 if closing else 1
        if name == "br":
            held.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        link = 0
        if closing:
            i = last((name,))
            if i >= 0 and (i == len(names) - 1 or name != "p" and (name in IN_TABLES or i > last(CELLS))):
                close_to(i)
            continue
        if name in ENDS_P and names and names[-1] == "p":
            close_to(len(names) - 1)
        if name in IMPLIED:
            ends, within = IMPLIED[name]
            while (i := last(ends)) > last(within):
                close_to(i)
                if name not in ("tr", "tbody"):
                    break
        if name in EMPTY or name in ("html", "body") and any(labels[i] == name for i in places.get(name, ())):
            continue
        tag = label(name, m["attrs"] if m["name"] else m["attrs2"])
        state = inside(tag, *noted[-1])
        places.setdefault(name, []).append(len(names))
        names.append(name)
        if len(noted) > DEPTH and (noted[-1][1] or state == noted[-1]):
            labels.append(None)
        else:
            labels.append(tag)
            noted.append(state)
            out.append((1, tag, 0))
    flush()
    close_to(0)
    return out


# Wrappers


@dataclass
class Slot:
    """The texts directly in an element: how often there were any, the text if it was always the same, letters, and those in links."""

    pages: int
    same: str | None
    letters: int
    linked: int

    def merge(self, other: Slot) -> None:
        self.pages += other.pages
        self.same = self.same if self.same == other.same else None
        self.letters += other.letters
        self.linked += other.linked


@dataclass
class Element:
    """An element of a wrapper: how many of its kind were seen, its slot, and its children in groups, in order."""

    label: str
    seen: int = 1
    slot: Slot | None = None
    groups: list[Group] = field(default_factory=list)
    kinds: frozenset[int] = frozenset()  # of the root: hashes of pages, PAGES of them at most

    def merge(self, other: Element) -> None:
        self.groups = align(self.groups, other.groups)
        self.kinds = frozenset(sorted(self.kinds | other.kinds)[:PAGES])
        self.seen += other.seen
        if self.slot and other.slot:
            self.slot.merge(other.slot)
        self.slot = self.slot or other.slot


@dataclass
class Group:
    """Elements in order; more than one, or one that came again, if repeated. No label is in two groups of a parent."""

    elements: dict[str, Element]
    repeated: bool = False
    seen: int = 1

    def join(self, other: Group) -> None:
        for name, e in other.elements.items():
            if name in self.elements:
                self.elements[name].merge(e)
            else:
                self.elements[name] = e


def collapse(groups: list[Group], first: int, last: int) -> None:
    """Makes groups first to last one repeated group."""
    if first != last or not groups[first].repeated:
        whole = groups[first]
        for g in groups[first + 1 : last + 1]:
            whole.join(g)
            whole.seen = max(whole.seen, g.seen)
        whole.repeated = True
        groups[first : last + 1] = [whole]


def fold(groups: list[Group], new: Element) -> None:
    """Adds the next sibling: one that came before closes a square, from its first appearance on."""
    for i, g in enumerate(groups):
        if new.label in g.elements:
            collapse(groups, i, len(groups) - 1)
            groups[i].elements[new.label].merge(new)
            return
    groups.append(Group({new.label: new}))


def align(a: list[Group], b: list[Group]) -> list[Group]:
    """Aligns the children of two elements: what one side lacks stays with fewer sightings (optional), what crosses is repeated."""
    out, last = a, -1
    for g in b:
        places = [i for i, x in enumerate(out) if not x.elements.keys().isdisjoint(g.elements)]
        if not places:
            last += 1
            out.insert(last, g)
            continue
        low, high = min(places), max(places)
        if low < last:
            low, high = low, max(high, last)
        if low != high:
            collapse(out, low, high)
        seen = out[low].seen + g.seen
        out[low].join(g)
        out[low].repeated |= g.repeated
        out[low].seen = seen
        last = low
    return out


def wrapper(tokens: list[tuple[int, str, int]]) -> Element:
    """The wrapper of one page. Its root stands for the page."""
    root = Element("page")
    path, texts = [root], [[]]
    links = [0]
    for kind, value, linked in tokens:
        if kind == 1:
            path.append(Element(value))
            texts.append([])
            links.append(0)
        elif kind == 0:
            texts[-1].append(value)
            links[-1] += linked
        else:
            done(path[-1], texts.pop(), links.pop())
            e = path.pop()
            fold(path[-1].groups, e)
    done(root, texts[0], links[0])
    root.kinds = frozenset([hash_text("\n".join(v for k, v, _ in tokens if not k))])
    return root


def done(e: Element, texts: list[str], linked: int) -> None:
    if texts:
        said = "\n".join(texts)
        e.slot = Slot(1, said if len(said) <= 400 else f"{hash_text(said):016x}", sum(map(len, texts)), linked)


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


def expression(e: Element) -> str:
    """The wrapper as a union-free regular expression: (...)? optional, (...)+ repeated, #text a slot, quoted text a constant."""
    inside = []
    if e.slot:
        said = f'"{e.slot.same[:40]}"' if e.slot.same and e.slot.pages > 1 else "#text"
        inside.append(said if e.slot.pages >= e.seen else f"({said})?")
    for g in e.groups:
        alone = len(g.elements) == 1
        body = "".join(expression(x) if alone else f"({expression(x)})?" for x in g.elements.values())
        optional = g.seen < e.seen
        inside.append(f"({body})*" if optional and g.repeated else f"({body})+" if g.repeated else f"({body})?" if optional else body)
    return f"<{e.label}>{''.join(inside)}</{e.label.partition(':')[0]}>"


def place_of(path: tuple[str, ...]) -> int:
    """A slot's path as a signed hash."""
    return hash_text("\0".join(path)) - (1 << 63)


def outside(tokens: list[tuple[int, str, int]]) -> set[tuple[tuple[str, ...], str]]:
    """(path, text) of a page's texts that lie outside of articles, and in no element of none: each once."""
    path: list[str] = []
    states, found = [(False, False)], set()
    for kind, value, _ in tokens:
        if kind == 1:
            path.append(value)
            states.append(inside(value, *states[-1]))
        elif kind == -1:
            path.pop()
            states.pop()
        elif states[-1] == (False, False):
            found.add((tuple(path), value))
    return found


def main_slots(root: Element, said: dict[int, set[int]] | None = None) -> dict[tuple[str, ...], frozenset[int]]:
    """Paths (labels from the page down) of the slots that hold main text, each with hashes of texts that are the host's template.

    said: by place_of(), the texts that a share of TEMPLATE of the host's pages say outside of articles.
    """
    wide: list[tuple[tuple[str, ...], Slot, bool]] = []

    def walk(e: Element, path: tuple[str, ...], within: bool, optional: bool):
        name, _, kind = e.label.partition(":")
        within = within or name in ARTICLE or kind == "main"
        if silent(name, kind, within and not (name in ARTICLE or kind == "main")):
            return
        if e.slot:
            # a place that isn't optional, on any page, and holds a constant
            constant = known and not optional and not within and e.slot.same is not None and e.slot.pages == root.seen
            if not constant:
                wide.append((path, e.slot, within))
        for g in e.groups:
            if g.repeated and not within and not any(articles(x) for x in g.elements.values()):
                letters, linked = (sum(n) for n in zip(*(said_in(x) for x in g.elements.values())))
                if linked > LINKS * letters:
                    continue
            for x in g.elements.values():
                walk(x, (*path, x.label), within, optional or g.repeated or x.seen < e.seen)

    known = len(root.kinds) >= PAGES
    walk(root, (), False, False)
    return {path: frozenset() if within or not known else frozenset((said or {}).get(place_of(path), ())) for path, slot, within in wide if within or slot.linked <= LINKS * slot.letters}


def said_in(e: Element) -> tuple[int, int]:
    """Letters in an element and below, and those in links; elements of no article don't count."""
    name, _, kind = e.label.partition(":")
    if silent(name, kind, False):
        return 0, 0
    letters, linked = (e.slot.letters, e.slot.linked) if e.slot else (0, 0)
    for g in e.groups:
        for x in g.elements.values():
            more = said_in(x)
            letters, linked = letters + more[0], linked + more[1]
    return letters, linked


def articles(e: Element) -> bool:
    """Whether an element begins an article, or one below it does."""
    return is_article(e.label) or any(articles(x) for g in e.groups for x in g.elements.values())


def silent(name: str, kind: str, within: bool) -> bool:
    """An element of no article; within: it lies in one."""
    if name in SILENT or kind in ("advert", "comments", "notice", "menu", "side", "foot", "hidden"):
        return name not in ARTICLE and name not in ("html", "body") or kind in ("advert", "comments", "hidden") and name not in ("html", "body")
    return not within and (name == "header" or kind == "head") and name not in ("html", "body")


def extract(tokens: list[tuple[int, str, int]], slots: dict[tuple[str, ...], frozenset[int]]) -> str:
    """The page's texts in main slots, joined by two line feeds; if the page has articles or a main part, those in them."""
    path: list[str] = []
    found, inner = [], 0
    depth = 0  # of article elements that are open
    for kind, value, _ in tokens:
        if kind == 0:
            template = slots.get(tuple(path))
            if template is not None and not (template and hash_text(value) in template):
                found.append((value, depth > 0))
                inner += depth > 0
        elif kind == 1:
            path.append(value)
            depth += is_article(value)
        else:
            depth -= is_article(path.pop())
    return "\n\n".join(t for t, within in found if within or not inner)


@lru_cache(1 << 14)
def inside(tag: str, within: bool, dead: bool) -> tuple[bool, bool]:
    """Whether what is in an element lies in an article, and in an element of none, by the same of where the element lies."""
    name, _, kind = tag.partition(":")
    own = name in ARTICLE or kind == "main"
    return within or own, dead or silent(name, kind, within and not own)


def is_article(tag: str) -> bool:
    name, _, kind = tag.partition(":")
    return (name in ARTICLE or kind == "main") and kind not in ("advert", "comments", "hidden")


# Over DataFrames


def host(url: str | None) -> str:
    """The host of a URL in lower case, or nothing."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


class _Infer:
    """Reads (url, html); gives (host, part, wrapper): a wrapper for each host among some pages."""

    PAGES = 2000

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Element] = {}
        pages = 0
        for batch in batches:
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = wrapper(stream(html))
                if (name := host(url)) in held:
                    held[name].merge(own)
                else:
                    held[name] = own
                pages += 1
                if pages % self.PAGES == 0 and len(held) > self.PAGES // 2:
                    yield self.rows(held)
                    held = {}
        yield self.rows(held)

    @staticmethod
    def rows(held: dict[str, Element]) -> pa.RecordBatch:
        names = list(held)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([hash_text(f"{n}{e.seen}") % 64 for n, e in held.items()], pa.int32()), pa.array([pickle.dumps(held[n]) for n in names], pa.binary())], names=["host", "part", "wrapper"])


class _Merge:
    """Reads (host, wrapper), sorted by host; gives each host's merged wrapper."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for batch in batches:
            for h, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = pickle.loads(raw)
                if h == name:
                    held.merge(own)
                    continue
                if held:
                    yield self.row(name, held)
                name, held = h, own
        if held:
            yield self.row(name, held)

    @staticmethod
    def row(name: str, e: Element) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([e.seen]), pa.array([pickle.dumps(e)], pa.binary())], names=["host", "pages", "wrapper"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, wrapper) over all pages; wrapper is a pickled Element. Null and odd URLs share the empty host."""
    parts = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_Infer(), "host string, part int, wrapper binary")
    few = parts.repartition("host", "part").sortWithinPartitions("host", "part").select("host", "wrapper").mapInArrow(_Merge(), "host string, pages long, wrapper binary")
    return few.select("host", "wrapper").repartition("host").sortWithinPartitions("host").mapInArrow(_Merge(), "host string, pages long, wrapper binary")


def expressions(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pages, expression): each host's wrapper as a union-free regular expression."""

    def show(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([expression(pickle.loads(x)) for x in b.column(2).to_pylist()], pa.string())], names=["host", "pages", "expression"])

    return wrappers(pages, url_col, html_col).mapInArrow(show, "host string, pages long, expression string")


class _Count:
    """Reads (url, html); gives (host, place, said, pages): how many pages of some say a text outside of articles."""

    ROWS = 100_000

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], int] = {}
        places: dict[tuple[str, ...], int] = {}
        for batch in batches:
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name = host(url)
                for path, text in outside(stream(html)):
                    if path not in places:
                        if len(places) > self.ROWS:
                            places.clear()
                        places[path] = place_of(path)
                    key = name, places[path], hash_text(text) - (1 << 63)
                    held[key] = held.get(key, 0) + 1
                if len(held) > self.ROWS:
                    yield self.rows(held)
                    held = {}
        yield self.rows(held)

    @staticmethod
    def rows(held: dict[tuple[str, int, int], int]) -> pa.RecordBatch:
        columns = [*(pa.array([k[i] for k in held], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))), pa.array(held.values(), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["host", "place", "said", "pages"])


def templates(pages: DataFrame, known: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, places, said): the texts that a share of TEMPLATE or more of a host's pages say outside of articles, counted over all pages.

    known: (host, pages). Counts are summed before they are shuffled, by host, place and text.
    """
    counts = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_Count(), "host string, place long, said long, pages long")
    counts = counts.groupBy("host", "place", "said").agg(F.sum("pages").alias("n"))
    often = counts.join(known.where(F.col("pages") >= PAGES), "host").where(F.col("n") >= TEMPLATE * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list(F.struct("place", "said")).alias("often")).select("host", F.col("often.place").alias("places"), F.col("often.said").alias("said"))


class _Apply:
    """Reads (id, url, html, wrapper); gives (id, url, text, n_chars)."""

    def __init__(self, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, set] = {}
        for batch in batches:
            texts = []
            for html, raw in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if raw not in known:
                    if len(known) > 200:
                        known.clear()
                    known[raw] = pickle.loads(raw) if raw is not None else {}
                texts.append(extract(stream(html), known[raw]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=self.schema)


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads (host, wrapper, places, said); gives (host, slots): main_slots(), pickled."""
    for b in batches:
        slots = []
        for raw, places, said in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            of: dict[int, set[int]] = {}
            for p, h in zip(places or (), said or ()):
                of.setdefault(p, set()).add(h + (1 << 63))
            slots.append(pickle.dumps(main_slots(pickle.loads(raw), of)))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.binary())], names=["host", "slots"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url, text and n_chars (code points).

    Blocks are joined by two line feeds in page order; a null or empty page, or one without main text, has an empty text.
    Repeated rows, null ids and null URLs stay; other columns are ignored; an empty table gives an empty result.
    """
    whole = cut_lineage(wrappers(pages, url_col, html_col))
    whole = whole.join(templates(pages, whole.select("host", "pages"), url_col, html_col), "host", "left")
    slots = cut_lineage(whole.select("host", "wrapper", "places", "said").mapInArrow(_slots, "host string, slots binary"))
    schema = T.StructType([column(pages, id_col), column(pages, url_col), *T.StructType.fromDDL("text string, n_chars long").fields])
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    own = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"), name.alias("__host"))
    size = slots.agg(F.sum(F.octet_length("slots") + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        slots = F.broadcast(slots)  # else the join is left to Spark, which splits a host that has very many pages
    joined = own.join(slots, own["__host"] == slots["host"], "left")
    return joined.select(F.col(id_col), F.col(url_col), "__html", "slots").mapInArrow(_Apply(schema), schema)
