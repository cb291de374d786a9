"""Main text of web pages: markup tells zones, a suffix array per host tells boilerplate.

A page is cut into blocks in three zones: *dropped* (menus, page headers, footers, sidebars, forms, adverts, notices,
comments, scripts: known by tag, role, class or id), *main* (inside article or main) and *other*. Pages of a host are
read together: their blocks' tokens form one stream, sorted by suffix to a depth of `DEPTH` tokens (prefix doubling);
equal neighbours are strings that repeat, and how many different pages have each tells boilerplate from text.

Blocks covered by strings that many pages of the host share are removed: in the main zone only if most pages have them,
as articles quote and copy each other (in the test tables a passage of an article is on 487 of a host's 4529 pages, so
removing whatever repeats would lose text); elsewhere if a few pages have them. The text is the main zone's blocks that
are left, or, in a page without a main zone, the other blocks.

Pages of a host with the same blocks are one page when strings are counted, and all of them get its text.

Large hosts are dealt to several shards by a hash of the page, so no host is one task. Counts and shares are those of the whole
host all the same: a string that a share of the host's pages have is one that this share of some shard's pages have, so shards
name such strings, count the named ones of all shards of the host, and the sums decide.
"""

from __future__ import annotations

import bisect
import html
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm import blocks as B
from skyloom.llm.frames import checkpointed, trimmed
from skyloom.llm.substring_dedup import word_hashes

SHARD_BYTES = 4 << 20
BROADCAST_HOSTS = 100_000
BROADCAST_COPIES = 1_000_000
DEPTH = 8
MAIN_SHARE, MAIN_PAGES = 0.6, 12
OTHER_SHARE, OTHER_PAGES = 0.2, 3
COVERED = 0.8
"""A block is removed if this part of its tokens is covered."""

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)>|<[/!?a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_DROPPED = {"head", "nav", "aside", "footer", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "map", "search", "fieldset", "datalist"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "sidebar", "rail", "widget", "widgets", "related",
    "recommended", "recommendations", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "menu", "nav", "navbar", "navigation", "masthead", "footer", "copyright",
    "comment", "comments", "disqus", "discussion", "reply", "replies", "respond", "toolbar", "pagination", "pager", "search", "login", "paywall", "disclaimer",
}
_FORMS = {"has", "no", "not", "with", "without", "tag", "category", "cat"}
"""Classes that begin so tell what a page has or is about, not what the element is; nor do those that end in a state."""
_STATES = {"open", "closed", "enabled", "disabled"}
_LISTING = {"comment", "comments", "disqus", "discussion", "reply", "replies", "respond", "related", "recommended", "recommendations"}
"""Elements of these words hold articles that aren't the page's."""
_FLOWING = {"p", "li", "dt", "dd", "option", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "tr", "td", "th"}
"""Their end tags can be left out, or they hold no article."""
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_LISTS = {"ul", "ol", "dl", "select", "table", "menu"}
DROP, MAIN, OTHER = 0, 1, 2


def _class_words(value: str) -> set[str]:
    out: set[str] = set()
    for token in value.split():
        words = [w.lower() for w in _WORD.findall(token)]
        if words and words[0] not in _FORMS and words[-1] not in _STATES:
            out.update(words)
    return out


LOOK = 64
"""Tokens that are read ahead for an element's end before the ends of all elements of the page are found at once."""


def _after_raw(page: str, tag: str, at: int) -> int:
    """Where the page goes on after an element whose content is no markup."""
    close = re.compile(f"</{tag}", re.I).search(page, at)
    return len(page) if close is None else page.find(">", close.end()) + 1 or len(page)


class _Ends:
    """Where the elements of a page end and where it has articles, told in time linear in the page."""

    def __init__(self, page: str):
        self.page = page
        self.ends: dict[int, int] | None = None

    def _all(self) -> None:
        self.ends, self.marks = {}, {"main": [], "article": []}
        opened: dict[str, list[int]] = {}
        at = 0
        while at < len(self.page):
            m = _TOKEN.match(self.page, at)
            at, name = m.end(), (m[2] or "").lower()
            if not name:
                continue
            if name in _RAW and not m[1]:
                at = _after_raw(self.page, name, at)
            elif m[1]:
                if opened.get(name):
                    self.ends[opened[name].pop()] = m.start()
            else:
                opened.setdefault(name, []).append(at)
                if name in self.marks:
                    self.marks[name].append(m.start())
                elif m[3] and _own_main(m[3]):
                    self.marks["article"].append(m.start())

    def holds(self, at: int, tag: str, tags: set[str]) -> bool:
        """Whether the element of this tag that was opened before `at` holds one of the tags, or an element of such a role."""
        if self.ends is None:
            depth = 1
            for n, m in enumerate(_TOKEN.finditer(self.page, at)):
                if n >= LOOK:
                    break
                name = (m[2] or "").lower()
                if name == tag:
                    depth += -1 if m[1] else 1
                    if not depth:
                        return False
                if name and not m[1] and (name in tags or "article" in tags and m[3] and _own_main(m[3])):
                    return True
            else:
                return False
            self._all()
        end = self.ends.get(at, len(self.page))
        return any((i := bisect.bisect_left(self.marks[t], at)) < len(self.marks[t]) and self.marks[t][i] < end for t in tags)


def _own_main(attributes: str) -> bool:
    """Whether attributes mark the main zone."""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ("main", "article") or name == "itemprop" and value == "articlebody":
            return True
    return False


def _zone(tag: str, attributes: str, outer: int, ends: _Ends, at: int) -> int:
    """The zone of an element. Words of its class or id drop it, but not the main zone's own elements, nor what holds one
    (an element of comments or related articles may hold articles; a `main` is the page's)."""
    if outer == DROP or tag in _DROPPED:
        return DROP
    if tag == "header" and outer != MAIN:
        return DROP
    words: set[str] = set()
    was, inner = outer, MAIN if tag in ("article", "main") else outer
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name in ("class", "id"):
                words |= _class_words(value)
            elif name == "role":
                if value.lower() in _ROLES:
                    return DROP
                if value.lower() in ("main", "article"):
                    inner = MAIN
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return DROP
            elif name == "itemprop" and value.lower() == "articlebody":
                inner = MAIN
    own = tag in ("article", "main") or bool(attributes) and _own_main(attributes)
    if not own and (words & _WORDS or ("header" in words and was != MAIN and tag not in ("h1", "h2", "h3"))):
        tags = {"main"} if words & _LISTING else {"main", "article"}
        if tag in _FLOWING or not ends.holds(at, tag, tags):
            return DROP
    return inner


class _Open:
    """The elements that are open, with the places of each name: what a tag closes is found without a search."""

    def __init__(self):
        self.names: list[str] = []
        self.zones: list[int] = []
        self.places: dict[str, list[int]] = {}

    def kinds(self, name: str) -> list[str]:
        return [name, *(["#list"] if name in _LISTS else []), *(["#block"] if name in _BLOCK else [])]

    def push(self, name: str, zone: int) -> None:
        for kind in self.kinds(name):
            self.places.setdefault(kind, []).append(len(self.names))
        self.names.append(name)
        self.zones.append(zone)

    def last(self, *kinds: str) -> int:
        """The place of the innermost element of these kinds; -1 where there is none."""
        return max((self.places[k][-1] for k in kinds if self.places.get(k)), default=-1)

    def close(self, place: int) -> None:
        """Closes the element at this place and all inside it."""
        while len(self.names) > place:
            for kind in self.kinds(self.names.pop()):
                self.places[kind].pop()
            self.zones.pop()

    def zone(self) -> int:
        return self.zones[-1] if self.zones else OTHER


def blocks(page: str) -> list[tuple[int, str]]:
    """(zone, text) of the page's blocks outside the dropped zones, in page order."""
    out: list[tuple[int, str]] = []
    opened, ends = _Open(), _Ends(page)
    zone, text = OTHER, []

    def flush() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line and zone != DROP:
                out.append((zone, line))
            text.clear()

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if page[m.start()] != "<" or at - m.start() == 1:
                if zone != DROP:
                    text.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:  # an end tag closes the innermost open element of its name
            if tag in _BLOCK:
                flush()
            if (place := opened.last(tag)) >= 0:
                if (opened.zones[place - 1] if place else OTHER) != zone:
                    flush()
                opened.close(place)
                zone = opened.zone()
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in _RAW:
            at = _after_raw(page, tag, at)
            continue
        if tag in _BLOCK:
            flush()
            closed = opened.last("p", *_CLOSED_BY.get(tag, ()))  # by this element's beginning, if nothing stands between
            if closed >= 0 and closed >= opened.last("#list", *([] if tag in _CLOSED_BY else ["#block"])):
                opened.close(closed)
            zone = opened.zone()
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        inner = _zone(tag, m[3], zone, ends, at)
        if inner != zone:
            flush()
            zone = inner
        opened.push(tag, inner)
    flush()
    return out


def suffix_groups(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each position the number of its group among the suffixes sorted to `depth` tokens (a power of two), by prefix
    doubling; positions beyond the end count as zero."""
    rank, reach = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1, 1
    while reach < depth:
        following = np.zeros(len(rank), np.int64)
        following[:-reach] = rank[reach:]
        rank = np.unique(rank * (len(rank) + 2) + following, return_inverse=True)[1].astype(np.int64) + 1
        reach *= 2
    return rank - 1


class Strings:
    """The strings of `depth` tokens (fewer at a block's end) of different pages of a host, or of a shard of it."""

    def __init__(self, pages: list[list[tuple[int, str]]], depth: int = DEPTH):
        lines = [line for own in pages for _, line in own]
        self.pages, self.depth = pages, depth
        self.zone = np.array([z for own in pages for z, _ in own], np.int64)
        self.size = np.array([line.count(" ") + 1 for line in lines], np.int64)
        self.block = np.repeat(np.arange(len(lines)), self.size)
        self.page = np.repeat(np.repeat(np.arange(len(pages)), [len(own) for own in pages]), self.size)
        tokens = word_hashes("\n".join(lines).encode())
        at = np.arange(len(tokens))
        self.at = at + depth * self.block  # a block's end is `depth` zeros; strings don't reach into the next block
        stream = np.zeros(len(tokens) + depth * len(lines), np.uint64)
        stream[self.at] = tokens
        _, first, self.group = np.unique(suffix_groups(stream, depth)[self.at], return_index=True, return_inverse=True)
        ends = np.minimum(at + depth, np.repeat(np.cumsum(self.size), self.size))
        self.key = B.runs_hash(tokens, first, ends[first], B.BASE2).view(np.int64)
        """What tells a group's string in other shards."""

    def counts(self, counted: np.ndarray) -> np.ndarray:
        """Of each group, how many of the `counted` pages have its string."""
        n, use = max(1, len(self.pages)), counted[self.page]
        return np.bincount(np.unique(self.group[use] * n + self.page[use]) // n, minlength=len(self.key))

    def gone(self, count: np.ndarray, n_pages: int) -> list[list[bool]]:
        """Whether each block of each page is boilerplate, by the groups' counts among the host's n_pages different pages."""
        need = np.where(self.zone == MAIN, max(MAIN_PAGES, MAIN_SHARE * n_pages), max(OTHER_PAGES, OTHER_SHARE * n_pages))
        hit = self.at[count[self.group] >= need[self.block]]
        cover = np.zeros(len(self.at) + self.depth * len(self.size) + 1, np.int64)
        cover[hit] += 1
        cover[hit + self.depth] -= 1
        covered = np.cumsum(cover)[self.at] > 0
        away = np.bincount(self.block[covered], minlength=len(self.size)) >= COVERED * self.size
        out, i = [], 0
        for own in self.pages:
            out.append(away[i : i + len(own)].tolist())
            i += len(own)
        return out


def different(table: pa.Table):
    """(host, its different pages, the rows of each, whether each counts here) of a task's rows."""
    hosts: dict[str, dict[tuple[bytes, str], list[int]]] = {}
    for i, (h, z, t) in enumerate(zip(table["host"].to_pylist(), table["zones"].to_pylist(), table["lines"].to_pylist(), strict=True)):
        hosts.setdefault(h, {}).setdefault((z, t), []).append(i)
    counts = np.asarray(table["counts"])
    for h, pages in hosts.items():
        rows = list(pages.values())
        yield h, [list(zip(z, t.split("\n"))) for z, t in pages], rows, counts[[r[0] for r in rows]]


def texts_of(table: pa.Table, known) -> pa.Table:
    """The texts of a task's rows; known(host) gives (pages, keys, counts) of a large host, None of one that is here whole."""
    texts = [""] * len(table)
    for host, pages, rows, counted in different(table):
        strings = Strings(pages)
        told = known(host)
        if told is None:
            n_pages, count = len(pages), strings.counts(counted)
        else:
            n_pages, keys, sums = told
            at = np.minimum(np.searchsorted(keys, strings.key), max(0, len(keys) - 1))
            count = np.where(keys[at] == strings.key, sums[at], 0) if len(keys) else np.zeros(len(strings.key), np.int64)
        for own, gone, same in zip(pages, strings.gone(count, n_pages), rows, strict=True):
            has_main = any(z == MAIN for z, _ in own)
            text = "\n".join(line for (z, line), away in zip(own, gone, strict=True) if not away and (z == MAIN or not has_main))
            for i in same:
                texts[i] = text
    return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array(list(map(len, texts)), pa.int64())})


def named_strings(table: pa.Table) -> pa.Table:
    """(host, key, n): a row without a key has the number of a shard's pages; keys are strings that a share of them have."""
    out = []
    for host, pages, _, counted in different(table.filter(pc.invert(table["whole"]))):
        n = int(counted.sum())
        strings = Strings(pages)
        named = strings.key[strings.counts(counted) >= max(1, OTHER_SHARE * n)] if n else []
        out += [(host, None, n), *((host, int(k), 0) for k in named)]
    hosts, keys, ns = zip(*out) if out else ((), (), ())
    return pa.table({"host": pa.array(hosts, pa.string()), "key": pa.array(keys, pa.int64()), "n": pa.array(ns, pa.int64())})


def named_counts(table: pa.Table, named: pa.Table) -> pa.Table:
    """(host, key, pages, n) of a shard's strings among the host's named ones, and a row without a key."""
    wanted = {h: (n, np.array(k, np.int64)) for h, n, k in zip(*(named[x].to_pylist() for x in ("host", "pages", "keys")), strict=True)}
    out = []
    for host, pages, _, counted in different(table.filter(pc.invert(table["whole"]))) if len(wanted) else ():
        n, keys = wanted[host]
        out.append((host, None, n, 0))
        if len(keys):
            strings = Strings(pages)
            count = strings.counts(counted)
            out += [(host, int(strings.key[i]), n, int(count[i])) for i in np.flatnonzero(np.isin(strings.key, keys) & (count > 0))]
    columns = list(zip(*out)) or [()] * 4
    return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("host", "key", "pages", "n"), columns, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)})


def extract_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its blocks, character references decoded and white space made one
    space, joined by line ends.

    Null or empty pages have empty texts. A url without a host (null, say) makes pages of one nameless host. Repeated
    rows and other copies are one page when a host's pages are counted; cut-off markup is read as far as it goes. Empty
    tables give empty results; other columns are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract(pages[url], r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    base = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), host.alias("host"), F.coalesce(pages[html_column].cast("string"), F.lit("")).alias("html"))
    sizes = base.groupBy("host").agg(F.sum(F.octet_length("html")).alias("b"))
    total = int(sizes.agg(F.sum("b")).first()[0] or 0)
    # at most total / SHARD_BYTES hosts are large: while that is few they are broadcast, else they are joined
    large = sizes.where(F.col("b") > SHARD_BYTES).select("host", F.ceil(F.col("b") / SHARD_BYTES).cast("int").alias("parts"))
    few = max(1, 2 * total // SHARD_BYTES)

    def parse(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                found = [blocks(p) for p in part.column(3).to_pylist()]
                zones = pa.array([bytes(z for z, _ in own) for own in found], pa.binary())
                lines = pa.array(["\n".join(line for _, line in own) for own in found], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], zones, lines, part.column(4)], ["page_id", "url", "host", "zones", "lines", "parts"])

    shard = lambda salt: F.xxhash64("host", salt.cast("long"))
    of_large = shard(F.pmod(F.xxhash64("page_id", "url"), F.col("parts")))
    base = base.join(F.broadcast(large) if total // SHARD_BYTES <= BROADCAST_HOSTS else large, "host", "left").select("page_id", "url", "host", "html", "parts")
    parsed = lambda rows: rows.mapInArrow(parse, "page_id long, url string, host string, zones binary, lines string, parts int")
    result = "page_id long, url string, text string, n_chars long"
    placed = parsed(base).withColumn("content", F.xxhash64("host", "zones", "lines")).withColumn("shard", F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("host"), F.lit(few))).otherwise(of_large))
    columns = ["page_id", "url", "zones", "lines", "host", "shard", F.col("parts").isNull().alias("whole")]
    if large.isEmpty():
        return placed.select(*columns, F.lit(True).alias("counts")).groupBy("shard").applyInArrow(trimmed(lambda table: texts_of(table, {}.get)), result)
    # a page that several shards have counts in the first of them
    copies = parsed(base.where("parts is not null")).select(F.xxhash64("host", "zones", "lines").alias("content"), of_large.alias("shard"))
    copies = checkpointed(copies.groupBy("content").agg(F.min("shard").alias("first"), F.max("shard").alias("last")).where("first <> last").select("content", "first"))
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_COPIES else copies
    dealt = placed.join(copies, "content", "left").select(*columns, F.coalesce(F.col("first") == F.col("shard"), F.lit(True)).alias("counts"))
    shards = large.select("host", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).select("host", shard(F.col("salt")).alias("shard"))
    named = dealt.groupBy("shard").applyInArrow(trimmed(named_strings), "host string, key long, n long")
    asked = shards.join(named.groupBy("host").agg(F.sum("n").alias("pages"), F.collect_set("key").alias("keys")), "host").select("shard", "host", "pages", "keys")
    counted = dealt.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(trimmed(named_counts), "host string, key long, pages long, n long")
    sums = counted.groupBy("host", "key").agg(F.max("pages").alias("pages"), F.sum("n").alias("n"))
    sums = sums.groupBy("host").agg(F.max("pages").alias("pages"), F.sort_array(F.collect_list(F.when(F.col("key").isNotNull() & (F.col("n") >= OTHER_PAGES), F.struct("key", "n")))).alias("found"))
    told = shards.join(sums, "host").select("shard", "host", "pages", F.col("found.key").alias("keys"), F.col("found.n").alias("sums"))

    def extract(table: pa.Table, told: pa.Table) -> pa.Table:
        by_host = {h: (n, np.array(k, np.int64), np.array(c, np.int64)) for h, n, k, c in zip(*(told[x].to_pylist() for x in ("host", "pages", "keys", "sums")), strict=True)}
        return texts_of(table, by_host.get)

    return dealt.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(trimmed(extract), result)
