"""Main text of web pages: the markup names what can be main text, a host-wide suffix array takes the boilerplate out of it."""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .words import Words, mix64, slices

#: Tokens of a run, and pages of a host it must stand on, to be boilerplate.
RUN, PAGES = 8, 3
#: Tokens of one suffix array; a host with more is dealt over several and their counts are added up.
TOKENS = 400_000
#: Characters of a page for each word, to reckon the number of arrays.
LETTERS = 8
#: The share of its words in repeated windows from which an article is a copy, not boilerplate.
COPIED = 0.5

MAIN, OPEN, CHROME = 0, 1, 2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas audio video xmp".split())
#: Of these, what nothing but the end tag ends; the others, if left open, hold nothing.
ENDLESS = frozenset("script style textarea title xmp".split())
OUTSIDE = frozenset("nav header footer aside form head button select dialog menu fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead comment comments disqus share sharing social related recommended newsletter subscribe subscription popup modal overlay widget signup login pagination pager toolbar".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())

#: A start tag closes an open element of these names, unless one of the others is between them.
_LISTS, _TABLES = frozenset("ul ol menu dir".split()), frozenset("table".split())
CLOSES = {"li": (frozenset({"li"}), _LISTS), **dict.fromkeys(("dt", "dd"), (frozenset({"dt", "dd"}), frozenset({"dl"})))}
CLOSES |= {**dict.fromkeys(("td", "th"), (frozenset({"td", "th"}), _TABLES)), "tr": (frozenset({"tr"}), _TABLES), **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset({"tbody", "thead", "tfoot"}), _TABLES))}
_PARAGRAPH = (frozenset({"p"}), (BLOCK - {"p"}) | {"button"})

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def _is_chrome(tag: str, attributes: str) -> bool:
    if tag in OUTSIDE:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if tag != "main" and any(token in NAMED for token in value.lower().split()):
                return True
        elif name == "role":
            if value.lower() in ROLES:
                return True
        elif _hides(name, value):
            return True
    return False


def _hides(name: str, value: str) -> bool:
    return name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower())


def _is_hidden(attributes: str) -> bool:
    return any(_hides(name.lower(), a or b or c) for name, a, b, c in _ATTRIBUTE.findall(attributes))


def _is_main(tag: str, attributes: str) -> bool:
    return tag in ("article", "main") or _role(attributes) == "main"


def _tags(html: str):
    """(start, end, tag, closing, attributes) of each tag in page order. Of an element in RAW only the text before and after it is left."""
    at, size = 0, len(html)
    while (found := _TAG.search(html, at)) is not None:
        at, tag = found.end(), (found[2] or "").lower()
        if tag in RAW and not found[1] and not found[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
            at = end.end() if end else size if tag in ENDLESS else at
            tag = ""
        yield found.start(), at, tag, bool(found[1]), found[3] or ""


def _implied(stack: list, tag: str) -> int | None:
    """Where the stack is cut by the end tags that the start of ``tag`` implies."""
    cut = None
    for names, fence in ([CLOSES[tag]] if tag in CLOSES else []) + ([_PARAGRAPH] if tag in BLOCK else []):
        for i in range(len(stack) - 1 if cut is None else cut - 1, -1, -1):
            if stack[i][0] in names:
                cut = i
                break
            if stack[i][0] in fence:
                break
    return cut


def _wrappers(tags: list, size: int) -> tuple[set[int], bool]:
    """Numbers of the start tags of elements that only look like chrome: they hold an article or main element, or are
    a form around half of the page or more. Also whether an article or main element stands outside all chrome."""
    doubtful, clean = set(), False
    stack: list[tuple[str, int, int, bool]] = []  # tag, number, start, whether it is a chrome element

    def ended(gone: list, at: int) -> None:
        doubtful.update(number for tag, number, start, _ in gone if tag == "form" and 2 * (at - start) >= size)

    for number, (start, _, tag, closing, attributes) in enumerate(tags):
        if not tag:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    ended(stack[i:], start)
                    del stack[i:]
                    break
            continue
        cut = _implied(stack, tag)
        if cut is not None:
            ended(stack[cut:], start)
            del stack[cut:]
        if tag in VOID or attributes.endswith("/"):
            continue
        chrome = _is_chrome(tag, attributes)
        if _is_main(tag, attributes) and not any(_is_hidden(tags[n][4]) for _, n, _, _ in stack) and not _is_hidden(attributes):
            inside = any(_is_main(t, tags[n][4]) for t, n, _, _ in stack)
            if not inside:
                doubtful.update(n for _, n, _, c in stack if c)
                if chrome:
                    doubtful.add(number)
                clean = clean or not chrome and not any(c and t != "form" for t, _, _, c in stack)
        stack.append((tag, number, start, chrome))
    ended(stack, size)
    return doubtful, clean


def blocks(html: str) -> list[tuple[int, str]]:
    """(kind, text) of each block in page order, white space made single. kind: MAIN in an article or main element,
    CHROME in a menu, header, footer, sidebar, notice, advert, form or comment, OPEN elsewhere.

    Chrome around an article or main element and a form around half of the
    page are OPEN; an article in such chrome is MAIN if the page has none
    outside chrome, else OPEN. Hidden elements stay CHROME.
    """
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int]] = []  # open elements and the kind of what is in them
    kind, text, at = OPEN, [], 0
    tags = list(_tags(html))
    doubtful, clean = _wrappers(tags, len(html))

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            if words:
                out.append((kind, words))
            text.clear()

    def close(i: int) -> None:
        nonlocal kind
        below = stack[i - 1][1] if i else OPEN
        if stack[i][1] != kind or below != kind:
            flush()
        del stack[i:]
        kind = below

    teaser = 0  # depth of the stack outside the doubtful chrome around it, where a page has its article elsewhere
    for number, (start, end, tag, closing, attributes) in enumerate(tags):
        if start > at:
            text.append(unescape(html[at:start]))
        at = end
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            teaser = min(teaser, len(stack))
            continue
        cut = _implied(stack, tag)
        if cut is not None:
            flush()
            close(cut)
            teaser = min(teaser, len(stack))
        if tag in VOID or attributes.endswith("/"):
            if tag == "br":
                text.append(" ")
            continue
        inner = kind
        if kind == CHROME:
            # the heading of an article stands in its header
            if tag in HEADING and any(k == MAIN for _, k in stack) and stack[-1][0] == "header":
                inner = MAIN
        elif _is_chrome(tag, attributes) and number not in doubtful:
            inner = CHROME
        elif _is_main(tag, attributes):
            own = number in doubtful
            inner = kind if kind == MAIN else OPEN if clean and (own or teaser) else MAIN
        if number in doubtful and tag != "form" and not teaser:
            teaser = len(stack) + 1
        if inner != kind:
            flush()
        stack.append((tag, inner))
        kind = inner
    text.append(unescape(html[at:]))
    flush()
    return out


def _role(attributes: str) -> str:
    found = re.search(r"\brole\s*=\s*[\"']?(\w+)", attributes) if "role" in attributes else None
    return found[1].lower() if found else ""


def windows(tokens: np.ndarray, pages: np.ndarray, run: int) -> np.ndarray:
    """For each place the class of the ``run`` tokens from there, -1 where they leave the page.

    This sorts the suffixes of the joined streams by doubling: ranks of the
    first 1, 2, 4, ... tokens, until ``run`` are told apart. Suffixes of one
    class share a prefix of ``run`` tokens or more.
    """
    n = len(tokens)
    if n < run:
        return np.full(n, -1)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    have = 1
    while have < run:
        step = min(have, run - have)
        far = np.full(n, -1, np.int64)
        far[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 1) + far + 1, return_inverse=True)[1].astype(np.int64)
        have += step
    whole = np.zeros(n, bool)
    whole[: n - run + 1] = pages[: n - run + 1] == pages[run - 1 :]
    return np.where(whole, rank, -1)


def _fold(found: list[tuple[int, str]]) -> bytes:
    """Blocks as compressed lines; white space in them is single, so none has a line break."""
    return zlib.compress("\n".join(f"{kind}{x}" for kind, x in found).encode(), 1)


def _unfold(page: bytes) -> list[tuple[int, str]]:
    return [(int(x[0]), x[1:]) for x in zlib.decompress(page).decode().split("\n") if x]


def _pages(batches):
    """Each page's blocks in place of its html."""
    for batch in batches:
        for part in slices(batch, "html", 1 << 23):
            pages = [_fold(blocks(html or "")) for html in part.column("html").to_pylist()]
            names = [x for x in part.schema.names if x != "html"]
            yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(pages, pa.binary())], [*names, "page"])


class _Stream:
    """The words of several pages in a row, with the page and the block of each."""

    def __init__(self, pages: list[list[tuple[int, str]]]):
        self.texts = [x for found in pages for _, x in found]
        self.main = np.array([kind == MAIN for found in pages for kind, _ in found], bool)
        self.page = np.repeat(np.arange(len(pages)), list(map(len, pages)))
        self.sizes = np.array([x.count(" ") + 1 for x in self.texts], np.int64)
        # white space in blocks is single spaces, so the words of the joined texts are theirs
        self.codes = Words(pa.array([" ".join(self.texts)], pa.large_string())).hash if self.texts else np.zeros(0, np.uint64)
        self.owner = np.repeat(self.page, self.sizes)
        # no window spans words of two pages, or of an article and others
        turn = np.ones(len(self.texts), bool)
        turn[1:] = (self.page[1:] != self.page[:-1]) | (self.main[1:] != self.main[:-1])
        self.stretch = np.repeat(np.cumsum(turn), self.sizes)


def _window_hash(codes: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """48 bits for the ``run`` words from each place."""
    h = np.zeros(len(at), np.uint64)
    for i in range(run):
        h = mix64(h ^ codes[at + i])
    return h >> np.uint64(16)


def _pack(h: np.ndarray) -> bytes:
    """Sorted 48-bit numbers as compressed planes of the bytes of their differences."""
    steps = np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return zlib.compress(np.ascontiguousarray(steps.T).tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _repeats(run: int, least: int):
    """Of one group of a host's pages: hashes of its distinct windows by share of the hashes, and how many pages each stands on.
    A host's only group leaves out windows on fewer than ``least`` pages."""

    def work(key: tuple[pa.Scalar, ...], pages: pa.Table) -> pa.Table:
        groups, kept, seen = pages.column("groups")[0].as_py(), [], set()
        for k, page in zip(pages.column("k").to_pylist(), pages.column("page").to_pylist(), strict=True):
            if k not in seen:
                seen.add(k)
                kept.append(_unfold(page))
        stream = _Stream(kept)
        codes, stretch, owner = stream.codes, stream.stretch, stream.owner
        cls = windows(codes, stretch, run)
        at = np.flatnonzero(cls >= 0)
        some, first, inverse = np.unique(cls[at], return_index=True, return_inverse=True)
        pairs = np.unique(inverse * len(kept) + owner[at])
        counts = np.minimum(np.bincount(pairs // len(kept), minlength=len(some)), 255)
        h = _window_hash(codes, at[first], run)
        if groups == 1:
            h, counts = h[counts >= least], counts[counts >= least]
        part = h % np.uint64(groups)
        order = np.lexsort((h, part))
        h, counts, part = h[order], counts[order].astype(np.uint8), part[order]
        names, begins = np.unique(part, return_index=True)
        rows = [(int(x), _pack(h[b:e]), zlib.compress(counts[b:e].tobytes(), 1)) for x, b, e in zip(names, begins, np.append(begins, len(h))[1:], strict=True)]
        shares, packed, sizes = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.string()), pa.array([key[1].as_py()] * len(rows), pa.int64()), pa.array(shares, pa.int64()), pa.array(packed, pa.binary()), pa.array(sizes, pa.binary())], ["host", "group", "share", "hashes", "counts"])

    return work


def _boilerplate(least: int):
    """Of one share of a host's window hashes: for each group those that stand on ``least`` pages of the host or more."""

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        groups, hashes = rows.column("group").to_pylist(), [_unpack(x) for x in rows.column("hashes").to_pylist()]
        counts = np.concatenate([np.frombuffer(zlib.decompress(x), np.uint8) for x in rows.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        bad = (np.bincount(inverse, weights=counts) >= least)[inverse]
        ends = np.cumsum(list(map(len, hashes)))
        own = [(g, h[bad[end - len(h) : end]]) for g, h, end in zip(groups, hashes, ends, strict=True)]
        own = [(g, _pack(h)) for g, h in own if len(h)]
        groups, packed = zip(*own, strict=True) if own else ((), ())
        return pa.table([pa.array([key[0].as_py()] * len(own), pa.string()), pa.array(groups, pa.int64()), pa.array(packed, pa.binary())], ["host", "group", "bad"])

    return work


def _gone(stream: _Stream, bad: np.ndarray, run: int) -> np.ndarray:
    """Which words are in repeated windows, whose hashes are in ``bad`` in order. A window that only reaches into a block by fewer than ``run`` words takes none of these."""
    n = len(stream.codes)
    if n < run or not len(bad):
        return np.zeros(n, bool)
    at = np.flatnonzero(stream.stretch[: n - run + 1] == stream.stretch[run - 1 :])
    h = _window_hash(stream.codes, at, run)
    hit = at[bad[np.minimum(np.searchsorted(bad, h), len(bad) - 1)] == h]
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + run, -1)
    gone = np.cumsum(covered)[:-1] > 0
    block = np.repeat(np.arange(len(stream.sizes)), stream.sizes)
    cut = np.flatnonzero(np.append(True, (gone[1:] != gone[:-1]) | (block[1:] != block[:-1])))
    length = np.diff(np.append(cut, n))
    enough = length >= np.minimum(run, stream.sizes[block[cut]])
    return gone & np.repeat(enough, length)


def _main_texts(pages: list[list[tuple[int, str]]], bad: np.ndarray, run: int) -> list[str]:
    stream = _Stream(pages)
    gone = _gone(stream, bad, run)
    of_main = np.repeat(stream.main, stream.sizes)
    n = np.bincount(stream.owner[of_main], minlength=len(pages))
    copied = np.bincount(stream.owner[of_main & gone], minlength=len(pages)) >= COPIED * np.maximum(n, 1)
    ends = np.cumsum(stream.sizes)
    some = np.add.reduceat(gone, ends - stream.sizes) > 0 if len(ends) else np.zeros(0, bool)
    out, i = [], 0
    for page, found in enumerate(pages):
        kept = []
        for kind, x in found:
            if kind != CHROME:
                if some[i] and (kind == OPEN or not copied[page]):
                    own = gone[ends[i] - stream.sizes[i] : ends[i]]
                    x = " ".join(w for w, g in zip(x.split(" "), own, strict=True) if not g)
                if x:
                    kept.append(x)
            i += 1
        out.append("\n\n".join(kept))
    return out


def _texts(run: int):
    def work(pages: pa.Table, marks: pa.Table) -> pa.Table:
        packed = marks.column("bad").to_pylist()
        bad = np.unique(np.concatenate([_unpack(x) for x in packed])) if packed else np.zeros(0, np.uint64)
        texts = _main_texts([_unfold(page) for page in pages.column("page").to_pylist()], bad, run)
        return pa.table([pages.column("page_id"), pages.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return work


def extract(pages: DataFrame, *, run: int = RUN, least_pages: int = PAGES) -> DataFrame:
    """Main text of every row (page_id, url, html).

    The words of a host's pages go through a suffix array. Windows of ``run``
    words on ``least_pages`` pages or more are boilerplate (together they are
    just the longest repeats of ``run`` words or more), and the article or
    main element and the blocks the markup leaves open, on every page, keep
    what no such window covers. An article that such windows cover by half or
    more is a copy, not boilerplate, and stays whole. Menus, headers, footers,
    sidebars, notices, adverts, forms and comments count for the windows and
    are left out. A host with many words is dealt over several arrays, and the
    counts of windows are added up by their hash, so the split changes nothing.

    Returns page_id, url, text, n_chars. Null or empty html: empty text. Null
    url: a host of its own. Repeated rows: each extracted, one page for the
    counts. Empty table: empty. Other columns are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html").withColumn("k", F.xxhash64("page_id", "url", "html")).withColumn("host", host)
    sizes = rows.groupBy("host").agg(F.greatest(F.ceil(F.sum(F.length("html")) / (TOKENS * LETTERS)), F.lit(1)).cast("long").alias("groups"))
    dealt = rows.join(F.broadcast(stash(sizes.where("groups > 1"), "html-hosts")), "host", "left").withColumn("groups", F.coalesce("groups", F.lit(1)).cast("long"))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("k"), F.col("groups")))
    dealt = dealt.select("page_id", "url", "k", "host", "groups", "group", "html").mapInArrow(_pages, "page_id long, url string, k long, host string, groups long, group long, page binary")
    found = dealt.select("host", "group", "groups", "k", "page").groupBy("host", "group").applyInArrow(_repeats(run, least_pages), "host string, group long, share long, hashes binary, counts binary")
    bad = found.groupBy("host", "share").applyInArrow(_boilerplate(least_pages), "host string, group long, bad binary")
    bad = stash(bad, "html-repeats")
    both = dealt.select("host", "group", "page_id", "url", "page").groupBy("host", "group").cogroup(bad.groupBy("host", "group"))
    return both.applyInArrow(_texts(run), "page_id long, url string, text string, n_chars long")
