"""Main text of HTML pages: structure, and a host suffix array for what structure leaves open.

A page is read as blocks, each in a zone: *article* (inside article or main),
*chrome* or *closed* (inside navigation, headers, footers, sidebars, notices, adverts,
forms or reader comments, by tag, role, or a whole name in class, id or label; a
closed one holds no article of the page's own) or *open*. Names do not close
main or article, and where they leave no block, the largest container they took
is the text. In an article they take no container of at least 30 words that has more
words than all the rest of it, unless it is named as comments or related pages, nor
a section by its id. A form or fieldset goes unless it wraps the content: more words
than all else around it, and 20 and 10 more for each of its controls. An element
that is never closed does not close a main or article within it. An element is hidden by an
attribute `hidden`, by aria-hidden=true or by a style of display:none, and by no
other attribute's value. Scripts, styles
and other unseen elements are no blocks. The text of a page is its article and
open blocks without those that a host's pages repeat; where its article has at
least as many words of its own as its open blocks have, the article's alone:

1. The words of article and open blocks form one token stream a page. Every window of
   `width` tokens is keyed by its least hash of half as many tokens, and runs of
   windows with one key go to that key of their host, so no host is ever gathered
   in one task. A covered window's key is on as many pages as the window, so keys
   on too few pages are not sent on, nor windows whose hash is on too few.
2. The runs of a batch of keys are concatenated and their suffixes sorted by
   prefix doubling, and the pages of equal windows are counted. Windows on three
   pages or more, and on more than half of the pages of the host, are covered: a
   copied article is on some pages, furniture on most.
3. Blocks of which most tokens are covered go; unique ones stay, and so does the
   container with the most words where more than half of them would go, since
   that is the body of a copy. If no block would stay, all do.

Inside a block character references are decoded and white space runs become one
space; blocks are joined in page order by one space. Null html, and html
without any block, gives an empty text. Rows that repeat page_id, url and html
are one page to step 2. A null url has the empty host.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import CHUNK_BYTES, mix, prefix_sums, span_hash
from .shared import cut, members_of, small_batches, trimmed
from .suffix import sliding_min
from .urls import host_and_path

_ATTRIBUTES = r"""(?:[^<>"']|"[^"]*"|'[^']*')*"""
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|<(?P<unseen>script|style|noscript|template|iframe|svg|math|textarea|select|object|canvas|head|title)\b[^>]*>.*?(?:</(?P=unseen)\s*>|\Z)"
    rf"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>{_ATTRIBUTES})>",
    re.DOTALL | re.IGNORECASE,
)
_NAMED = re.compile(r"""(?<![\w-])(class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_MAY_HIDE = re.compile(r"hidden|display", re.IGNORECASE)
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed lists of element names and of the words that name page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("div section nav header footer aside form article main ul ol dl table tbody thead tfoot tr td th figure details dialog menu search fieldset blockquote body center button".split())
CHROME_TAGS = frozenset("nav aside dialog menu search button footer".split())
FORM_TAGS = frozenset(["form", "fieldset"])
CONTROLS = frozenset("input button select textarea".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies disqus respond widget widgets pagination pager toolbar skip masthead copyright legal complementary contentinfo form search dialog".split()
)
HEADER_WORDS = frozenset(["header", "topbar"])
#: Containers whose inner articles are not the page's own.
CLOSED_TAGS = frozenset("nav aside dialog menu search footer".split())
CLOSED_WORDS = frozenset("comment comments reply replies respond disqus related recommended recommendations sidebar aside footer".split())
#: First words of a name that says what else the element has, and last words that say no more than the first.
MODIFIERS = frozenset("has have no non not with without is show hide js".split())
GENERIC = frozenset("area bar block body bottom box btn button buttons column container content form group icons inner item items left links list main outer panel primary right row secondary section text top wrap wrapper".split())
#: Words that a form has to hold, and as many more for each of its controls, to be the content.
FORM_WORDS, CONTROL_WORDS = 20, 10
#: Words of a container inside an article that its name does not take if it has most of the article's.
BODY_WORDS = 30
#: Zones whose tokens are looked for on other pages of the host.
JUDGED = frozenset(["open", "article"])
#: Bits of a key that tell its host.
HOST_BITS = 24
#: Keys that most pages of a host share, for each bucket of runs that are sorted together.
BUCKET_KEYS = 20_000


def furniture(value: str, label: bool = False) -> set[str]:
    """Words that name an element by its class, id or role: each name's only, last, or first word before a generic one.

    A label is read as one name, of three words at most.
    """
    out = set()
    for name in [value] if label else value.split():
        words = _WORD.findall(_CAMEL.sub(" ", name).lower())
        if not words or words[0] in MODIFIERS or "with" in words or label and len(words) > 3:
            continue
        out.add(words[-1])
        if all(w in GENERIC for w in words[1:]):
            out.add(words[0])
    return out


@dataclass(slots=True)
class _Open:
    """An element that is open, as the blocks within it see it."""

    tag: str
    zone: str
    number: int
    forms: tuple[int, ...] = ()  # forms and fieldsets around it, outermost first
    article: int = 0  # outermost article or main
    named: int = 0  # outermost container in the article that has only a name of furniture


@dataclass(slots=True)
class _Block:
    zone: str
    text: str
    at: _Open

    @property
    def words(self) -> int:
        return self.text.count(" ") + 1


def _is_hidden(attributes: str) -> bool:
    if not _MAY_HIDE.search(attributes):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and _NO_DISPLAY.search(value):
            return True
    return False


def _own_bodies(found: list[_Block]) -> None:
    """Give back what a name alone took from an article, where it is most of the article's words."""
    total: dict[int, int] = {}
    taken: dict[tuple[int, int], int] = {}
    for b in found:
        if b.at.article and (b.zone == "article" or b.zone == "chrome by name"):
            total[b.at.article] = total.get(b.at.article, 0) + b.words
            if b.zone != "article" and b.at.named:
                key = (b.at.article, b.at.named)
                taken[key] = taken.get(key, 0) + b.words
    bodies = {key for key, n in taken.items() if n >= BODY_WORDS and 2 * n > total[key[0]]}
    for b in found if bodies else ():
        if b.zone == "chrome by name" and (b.at.article, b.at.named) in bodies:
            b.zone = "article"


def _without_forms(found: list[_Block], controls: dict[int, int]) -> None:
    """Close the forms that do not wrap the content; one in another is held against what the other has."""
    words: dict[int, int] = {}
    around: dict[int, int] = {}
    for b in found:
        n = b.words if b.zone in JUDGED else 0
        outer = 0
        for form in (0, *b.at.forms):
            words[form] = words.get(form, 0) + n
            around[form], outer = outer, form
    content = {f for f in controls if 2 * words.get(f, 0) > words.get(around.get(f, 0), 0) and words[f] >= FORM_WORDS + CONTROL_WORDS * controls[f]}
    for b in found:
        if not content.issuperset(b.at.forms):
            b.zone = "closed"


def blocks(page: str) -> list[tuple[str, str, int]]:
    """(zone, text, number of its container) of each block that has text, in page order."""
    out: list[_Block] = []
    stack = [_Open("", "open", 0)]
    containers = 0
    controls: dict[int, int] = {}  # of each form, those of forms within it not counted
    last_close: dict[str, int] = {}
    text: list[str] = []
    paragraph = ""  # zone of a chrome paragraph that is open

    def end_block():
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined:
                out.append(_Block(paragraph or stack[-1].zone, joined, stack[-1]))
            text.clear()

    def closed_after(tag: str, at: int) -> bool:
        if tag not in last_close:
            last_close[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}\b", page, re.IGNORECASE)), default=-1)
        return last_close[tag] > at

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["unseen"]:
                text.append(" ")
                if stack[-1].forms and m["unseen"].lower() in CONTROLS:
                    controls[stack[-1].forms[-1]] += 1
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        attributes = m["attributes"]
        if tag in CONTROLS and stack[-1].forms and not m["close"] and not re.search(r"""\btype\s*=\s*["']?hidden""", attributes, re.IGNORECASE):
            controls[stack[-1].forms[-1]] += 1
        if tag in ("br", "hr", "input"):
            text.append(" ")
            continue
        end_block()
        paragraph = ""
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        outer = stack[-1]
        zone, inside = outer.zone, outer.article
        named: set[str] = set()
        if "=" in attributes:
            for kind, *values in _NAMED.findall(attributes):
                words = furniture("".join(values), kind.lower() == "aria-label")
                if tag == "section" and zone == "article" and kind.lower() == "id":
                    words &= CLOSED_WORDS  # an anchor names what the section is about
                elif tag in FORM_TAGS:
                    words.discard("form")
                named |= words
        hidden = bool(attributes) and _is_hidden(attributes)
        chrome = tag in CHROME_TAGS or bool(named & CHROME_WORDS) or zone != "article" and (tag == "header" or bool(named & HEADER_WORDS)) or hidden
        sure = tag in CHROME_TAGS or tag == "header" or hidden
        if tag in CONTAINERS and tag != "body" and not attributes.endswith("/"):
            containers += 1
            if zone == "closed" and tag in ("article", "main"):
                first = next(k for k, e in enumerate(stack) if e.zone == "closed")
                if not any(e.tag not in CLOSED_TAGS or closed_after(e.tag, at) for e in stack[first:]):
                    zone = stack[first - 1].zone
            if zone == "closed" or tag in CLOSED_TAGS:
                zone = "closed"
            elif hidden and zone != "closed by name":
                zone = "chrome"
            elif tag == "main" or tag == "article" and zone != "closed by name":
                zone, inside = "article", inside or containers
            elif zone == "closed by name" or named & CLOSED_WORDS:
                zone = "closed" if sure else "closed by name"
            elif chrome:
                zone = "chrome" if sure or zone == "chrome" else "chrome by name"
            forms = outer.forms
            if tag in FORM_TAGS:
                forms += (containers,)
                controls[containers] = 0
            opens_named = outer.zone == "article" and zone == "chrome by name"
            stack.append(_Open(tag, zone, containers, forms, inside, containers if opens_named else outer.named if zone == "chrome by name" else 0))
        elif chrome and tag not in VOID and tag != "body":
            paragraph = "chrome" if sure else "chrome by name"
    text.append(page[at:] if at < len(page) else "")
    end_block()
    _own_bodies(out)
    if controls:
        _without_forms(out, controls)
    return [(b.zone, b.text, b.at.number) for b in out]


def _text_tokens(text: str) -> np.ndarray:
    """Hashes of the words of a text in which one space parts two words."""
    if not text:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(text.encode(), np.uint8)
    spaces = np.flatnonzero(data == 0x20)
    starts, ends = np.append(0, spaces + 1), np.append(spaces, len(data))
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + CHUNK_BYTES, "right")))
        first = starts[lo]
        out[lo:hi] = span_hash(prefix_sums(data[first : ends[hi - 1]]), starts[lo:hi] - first, ends[lo:hi] - first)
        lo = hi
    return out


def token_suffix_array(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by at least `depth` tokens, and the rank of each suffix by these."""
    _, rank = np.unique(codes, return_inverse=True)
    done = 1
    while done < depth:
        after = np.append(rank[done:] + 1, np.zeros(min(done, len(rank)), np.int64))[: len(rank)]
        _, rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)
        done *= 2
    return np.argsort(rank, kind="stable"), rank


def _window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` tokens that follow each other."""
    out = np.zeros(max(0, len(tokens) - width + 1), np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + tokens[k : k + len(out)]
    return mix(out)


@dataclass
class _Runs:
    """Runs of windows of a batch of pages that are new on their page and have one key."""

    tokens: np.ndarray
    hosts: np.ndarray  # hash of each page's host
    first: np.ndarray  # first token of each page
    windows: np.ndarray  # windows of each page
    different: np.ndarray  # different ones
    page: np.ndarray  # from here on one for each run
    heads: np.ndarray
    lasts: np.ndarray
    keys: np.ndarray


def _batch_runs(batch: pa.RecordBatch, width: int, html: str, url: str) -> _Runs | None:
    """Runs of a batch, whose keys carry the first HOST_BITS bits of the host's hash."""
    texts = [" ".join([text for zone, text, _ in blocks(page or "") if zone in JUDGED]) for page in batch.column(html).to_pylist()]
    sizes = np.array([text.count(" ") + 1 if text else 0 for text in texts], np.int64)
    tokens = _text_tokens(" ".join([text for text in texts if text]))
    n = len(tokens) - width + 1
    if n < 1:
        return None
    hosts = np.array([xxhash.xxh64_intdigest(host_and_path(address)[0]) for address in batch.column(url).to_pylist()], np.uint64)
    page, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    at = np.flatnonzero(np.arange(n) + width <= ends[page[:n]])
    if not len(at):
        return None
    gram = max(1, width // 2)
    grams = _window_hashes(tokens, gram)
    host = hosts[page[: len(grams)]]
    low = np.uint64(64 - HOST_BITS)
    keys = sliding_min(host >> low << low | mix(grams ^ host) >> np.uint64(HOST_BITS), width - gram + 1)
    windows = np.bincount(page[at], minlength=len(sizes))
    at = np.sort(at[np.unique(mix(_window_hashes(tokens, width)[at] ^ mix(page[at].astype(np.uint64))), return_index=True)[1]])
    cuts = (np.diff(at) != 1) | (keys[at[1:]] != keys[at[:-1]]) | (page[at[1:]] != page[at[:-1]])
    heads = at[np.append(True, cuts)]
    return _Runs(tokens, hosts, ends - sizes, windows, np.bincount(page[at], minlength=len(sizes)), page[heads], heads, at[np.append(cuts, True)], keys[heads])


def _side_by_side(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all rows of table(host, tokens), told apart by host, the row of each, and its place in the row."""
    tokens = table.column("tokens").to_pylist()
    sizes = np.array([len(t) // 8 for t in tokens], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    codes = np.frombuffer(b"".join(tokens), np.uint64) ^ mix(table.column("host").to_numpy().view(np.uint64))[owner]
    return codes, owner, np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[owner]


def repeated_tokens(pages: DataFrame, width: int = 6, html: str = "html", url: str = "url", least: int = 3, common: float = 0.5) -> DataFrame:
    """(page, twice, start, count) of token windows that `least` pages and more than `common` of the pages of the host have.

    pages has one row for each page. Of equal windows of a page only the first is told;
    `twice` says that the page has such. Keys, and then windows, that too few pages
    have to be covered are left out before the sort, so what is sorted for a key
    stays within 1 / common of what one page has of it, however many pages share it.
    """
    spark = pages.sparkSession

    def tell(batches):
        for batch in batches:
            if (runs := _batch_runs(batch, width, html, url)) is None:
                continue
            once = np.unique(mix(runs.keys ^ mix(runs.page.astype(np.uint64))), return_index=True)[1]
            hosts = runs.hosts[runs.windows > 0]
            keys = np.concatenate([runs.keys[once], hosts])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.arange(len(keys)) >= len(once))], ["key", "host"])

    def often(rows: DataFrame, of: DataFrame, on: str) -> DataFrame:
        return rows.join(of, on).where((F.col("pages") >= least) & (F.col("pages") > F.lit(common) * F.col("of")))

    # one row a page and key, so the count is that of pages
    told = cut(pages.select(url, html).mapInArrow(tell, "key long, host boolean").groupBy("key", "host").agg(F.count("*").alias("pages")).where(F.col("pages") >= least))
    code = F.shiftrightunsigned("key", 64 - HOST_BITS)
    hosts = told.where("host").select("key", F.col("pages").alias("of"))
    # hosts of one code: the one with fewer pages, which keeps more keys
    wanted = cut(often(told.where("not host").select("key", "pages", code.alias("code")), hosts.groupBy(code.alias("code")).agg(F.min("of").alias("of")), "code").select("key"))
    hosts = hosts.withColumnRenamed("key", "host")
    shared = members_of(wanted, "key")
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), wanted.count() // BUCKET_KEYS)

    def emit(batches):
        for batch in batches:
            if (runs := _batch_runs(batch, width, html, url)) is None:
                continue
            known, rows = set(), []
            pick = np.flatnonzero(shared(runs.keys))
            of = runs.page[pick]
            columns = (runs.keys[pick] % np.uint64(buckets), of, runs.different[of] < runs.windows[of], runs.heads[pick] - runs.first[of], runs.hosts[of], runs.heads[pick], runs.lasts[pick])
            for bucket, page, twice, start, host, head, last in zip(*(c.tolist() for c in columns)):
                run = runs.tokens[head : last + width].tobytes()
                content = xxhash.xxh64_intdigest(run, host)
                # a batch tells the tokens of a content once
                rows.append((bucket, batch.column("page")[page].as_py(), twice, start, content - (1 << 63), host if host < 1 << 63 else host - (1 << 64), None if content in known else run))
                known.add(content)
            values = list(zip(*rows)) or [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(values, kinds)], ["bucket", "page", "twice", "start", "content", "host", "tokens"])

    def windows(batches):
        for batch in batches:
            codes, owner, inner = _side_by_side(batch)
            sizes = np.bincount(owner, minlength=len(batch))
            at = np.flatnonzero(inner + width <= sizes[owner])
            row = owner[at]
            columns = [_window_hashes(codes, width)[at].view(np.int64), batch.column("host").to_numpy()[row], batch.column("pages").to_numpy()[row]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["window", "host", "pages"])

    def narrowed(batches):
        for batch in batches:
            codes, owner, inner = _side_by_side(batch)
            sizes = np.bincount(owner, minlength=len(batch))
            at = np.flatnonzero(inner + width <= sizes[owner])
            at = at[common_windows(_window_hashes(codes, width)[at].view(np.int64))]
            cuts = (np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])
            heads, lasts = at[np.append(True, cuts)[: len(at)]], at[np.append(cuts, True)[: len(at)]]
            row = owner[heads]
            tokens = batch.column("tokens").to_pylist()
            parts = [tokens[r][8 * a : 8 * (a + length)] for r, a, length in zip(row.tolist(), inner[heads].tolist(), (lasts - heads + width).tolist())]
            columns = [batch.column(c).take(pa.array(row)) for c in ("bucket", "host", "content", "pages")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(inner[heads], pa.int32()), pa.array(parts, pa.binary())], ["bucket", "host", "content", "pages", "start", "tokens"])

    def sort(table: pa.Table) -> pa.Table:
        codes, owner, inner = _side_by_side(table)
        sizes = np.bincount(owner, minlength=len(table))
        order, rank = token_suffix_array(codes, width)
        # doubling may compare more than `width` tokens: neighbours need not, so equal windows are grouped by their own rank
        window = rank if width & (width - 1) == 0 else _window_ranks(codes, width)
        order = order[(inner + width <= sizes[owner])[order]]
        # a page has a window once, so the pages of the contents that hold it add up
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, window[order], table.column("pages").to_numpy()[owner[order]])
        hit = np.sort(order[total[window[order]] >= least])
        seen = total[window[hit]]
        new = np.ones(len(hit), bool)
        new[1:] = (hit[1:] != hit[:-1] + 1) | (owner[hit[1:]] != owner[hit[:-1]]) | (seen[1:] != seen[:-1])
        heads = np.flatnonzero(new)
        at = hit[heads]
        row = owner[at]
        start = (inner[at] + table.column("start").to_numpy()[row]).astype(np.int32)
        return pa.table({"content": table.column("content").to_numpy()[row], "host": table.column("host").to_numpy()[row], "start": start, "count": np.diff(np.append(heads, len(hit))).astype(np.int32), "pages": seen[heads]})

    runs = cut(pages.select("page", url, html).mapInArrow(emit, "bucket int, page long, twice boolean, start int, content long, host long, tokens binary"))
    # equal runs of a host are sorted once, however many pages have them
    once = cut(runs.groupBy("bucket", "host", "content").agg(F.first("tokens", ignorenulls=True).alias("tokens"), F.count("*").alias("pages")))
    counted = once.mapInArrow(windows, "window long, host long, pages long").groupBy("window", "host").agg(F.sum("pages").alias("pages"))
    common_windows = members_of(often(counted, hosts, "host"), "window")
    pieces = once.mapInArrow(narrowed, "bucket int, host long, content long, pages long, start int, tokens binary")
    covered = often(pieces.groupBy("bucket").applyInArrow(sort, "content long, host long, start int, count int, pages long"), hosts, "host")
    places = runs.select("page", "twice", "host", "content", F.col("start").alias("first"))
    return places.join(covered.select("host", "content", "start", "count"), ["host", "content"]).select("page", "twice", (F.col("first") + F.col("start")).alias("start"), "count")


def _window_ranks(codes: np.ndarray, width: int) -> np.ndarray:
    _, rank = np.unique(codes, return_inverse=True)
    out = rank
    for k in range(1, width):
        after = np.append(rank[k:] + 1, np.zeros(min(k, len(rank)), np.int64))[: len(rank)]
        _, out = np.unique(out * (len(rank) + 2) + after, return_inverse=True)
    return out


def _named_away(page: str | None) -> str:
    """The largest container of a page of which names alone leave nothing."""
    texts: dict[int, list[str]] = {}
    for zone, text, where in blocks(page or ""):
        if zone.endswith("by name"):
            texts.setdefault(where, []).append(text)
    return max((" ".join(t) for t in texts.values()), key=lambda t: len(t.split()), default="")


def page_text(page: str | None, ranges=(), width: int = 6, share: float = 0.8, twice: bool = True) -> str:
    """The text of a page of which the ranges (start, count) of windows are covered; `twice`: some windows may be equal."""
    own = [(zone, where, text) for zone, text, where in blocks(page or "") if zone in JUDGED]
    if not own:
        return _named_away(page)
    counts = np.array([text.count(" ") + 1 for _, _, text in own], np.int64)  # one space between words
    hidden = np.zeros(len(own), np.int64)
    if ranges:
        step = np.zeros(int(counts.sum()) + 1, np.int64)
        if twice:  # equal windows of the page go the same way
            windows = _window_hashes(_text_tokens(" ".join([text for _, _, text in own])), width)
            told = np.zeros(len(windows), bool)
            for r in ranges:
                told[r["start"] : r["start"] + r["count"]] = True
            hit = np.flatnonzero(np.isin(windows, windows[told]))
            np.add.at(step, hit, 1)
            np.add.at(step, hit + width, -1)
        else:
            for r in ranges:
                step[r["start"]] += 1
                step[r["start"] + r["count"] + width - 1] -= 1
        gone = np.append(0, np.cumsum(np.cumsum(step)[:-1] > 0))
        ends = np.cumsum(counts)
        hidden = gone[ends] - gone[ends - counts]
    article = np.array([zone == "article" for zone, _, _ in own], bool)
    named, other = ((counts - hidden)[pick].sum() for pick in (article, ~article))
    if named == other == 0:
        named, other = counts[article].sum(), counts[~article].sum()
    take = np.flatnonzero(article) if article.any() and named >= other else np.arange(len(own))
    stay = [k for k in take.tolist() if hidden[k] < share * counts[k]]
    if stay:
        sizes: dict[int, np.ndarray] = {}
        for k in take.tolist():
            sizes[own[k][1]] = sizes.get(own[k][1], 0) + np.array([counts[k], 0 if k in stay else counts[k]])
        heaviest = max(sizes, key=lambda w: sizes[w][0])
        if 2 * sizes[heaviest][1] > sizes[heaviest][0]:
            stay = sorted({*stay, *(k for k in take.tolist() if own[k][1] == heaviest)})
    return " ".join(own[k][2] for k in stay or take.tolist())


def main_texts(pages: DataFrame, width: int = 6, share: float = 0.8) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    base = small_batches(pages).select(F.xxhash64(F.col("page_id").cast("long"), "url", "html").alias("page"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    repeated = cut(base.groupBy("page").count().where("count > 1"))

    def chosen(test):
        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(test(batch.column("page"))))

        return run

    once = base
    if not repeated.isEmpty():
        again = members_of(repeated, "page")
        once = base.mapInArrow(chosen(lambda c: ~again(c)), base.schema).union(base.mapInArrow(chosen(again), base.schema).dropDuplicates(["page"]))
    covered = cut(repeated_tokens(once, width).groupBy("page").agg(F.max("twice").alias("twice"), F.collect_list(F.struct("start", "count")).alias("ranges")))
    touched = members_of(covered, "page")

    def finish(batches):
        for batch in batches:
            if "ranges" not in batch.schema.names:
                batch = batch.filter(pa.array(~touched(batch.column("page"))))
            ranges, twice = (batch.column(c).to_pylist() if c in batch.schema.names else [None] * len(batch) for c in ("ranges", "twice"))
            texts = [page_text(h, r, width, share, t) for h, r, t in zip(batch.column("html").to_pylist(), ranges, twice)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = "page_id long, url string, text string, n_chars long"
    changed = base.mapInArrow(chosen(touched), base.schema).join(covered, "page", "left").mapInArrow(trimmed(finish), schema)
    same = base.mapInArrow(trimmed(finish), schema)
    return changed.union(same)
