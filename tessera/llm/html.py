"""Main text of web pages: structure first, then a suffix array for each host.

A page is cut into blocks.  What its markup names (menus, footers, adverts,
forms, comments and the like) is out; what an article or main element holds is
the main text, but for parts with a name that may or may not mean chrome (as
``id=search`` or ``class=related-work``).  Those parts, and on pages without
such an element all blocks that structure leaves open, need evidence: the
host's token streams of all blocks outside of articles, and of the doubtful
ones, are concatenated, their suffixes sorted, and what at least PAGES
different pages repeat is boilerplate; the unique runs stay.  Pages with equal
blocks, those in articles included, count once, so that copies of a page don't
take each other for boilerplate.

The sort stops at LENGTH tokens: an equal prefix of that length is all that
covering needs.  A host with more html than SHARD_BYTES is dealt over shards by
page, so that no task grows with a host.  Its repetitions are counted over all
shards, by hashes of LENGTH tokens and the pages that have them, and each shard
gets the hashes that it has; so the dealing doesn't show in the result.  Pages
are parsed once, and dealt out by host and shard once.

Null and empty pages have an empty text; unclosed, misnested and truncated
markup is read as far as it goes, in time in proportion to its length.  An
article in a menu, header or advert is taken for one behind it that was never
closed; in comments, sidebars and the like it isn't, unless the page has no
other.  Rows with one id are kept apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens of a repeated substring (a power of two); pages that must have it.
LENGTH, PAGES = 8, 3
SHARD_BYTES = 8 << 20
#: Hosts of several shards that are broadcast with their numbers of shards, at most; more are joined as Spark plans it.
BROADCAST_HOSTS = 1 << 18
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is not text of the page.
_RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "object", "canvas", "math", "title")
_CHROME = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "fieldset", "head", "label", "input"} | set(_RAW)
_BLOCK = set("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_SPACE = {"br", "td", "th", "wbr"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of names that mean chrome, and those that an id within an article may have by its subject.
_CHROME_WORDS = set(
    "ad ads advert adverts advertisement advertisements advertising banner sponsor sponsored promo promos promotion promotions cookie cookies consent gdpr notice alert newsletter "
    "subscribe subscription social share sharing sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies respond disqus related recommend recommended "
    "recommendations footer masthead popup modal overlay widget pagination pager toolbar login signup search skip hidden paywall".split()
)
_WEAK_WORDS = set("banner notice alert share sharing search skip hidden promotion promotions subscription social menu navigation related recommendations widget sponsor reply replies respond".split())
#: Words that say where or how, beside those.
_GENERIC_WORDS = set(
    "area article articles aside author bar block body bottom box button buttons center col column container content count form global group header icon icons info inline inner item items label left "
    "link links list main message meta outer page panel post posts right row section site slot stories story text thread title toggle top unit wrap wrapper".split()
)
_HEADER = re.compile(r"(?:^|[\s_-])(?:site|page|top|global)?-?header(?:$|[\s_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "form"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Names of what has articles of its own beside the page's.
_HOLDERS = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|respond|disqus|related|recommend(?:ed|ations)?|sidebar|widget|promos?)(?:$|[\s_-]|\d)", re.I)
_OWN = re.compile(r"(?:^|\s)(?:comment|reply|ad|advert|advertisement|promo|sponsored|related|recommended)(?:$|\s)", re.I)
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
FINE, DOUBTFUL, UNWANTED = 0, 1, 2


def _named(value: str, within: bool, anchor: bool) -> int:
    """What a class or an id says; `anchor`: an id within an article, which may be there for its subject."""
    said = FINE
    for name in value.lower().split():
        words = re.findall(r"[a-z]+", name)
        if not _CHROME_WORDS.isdisjoint(words):
            plain = all(w in _CHROME_WORDS or w in _GENERIC_WORDS for w in words) and not (anchor and not _WEAK_WORDS.isdisjoint(words))
            said = max(said, UNWANTED if plain or not within else DOUBTFUL)
    return said


def _judged(tag: str, raw: str, within: bool) -> int:
    """Whether an element is part of the text, by its tag and attributes; `within`: in an article or main element."""
    if tag in _CHROME or (tag == "header" and not within):
        return UNWANTED
    if tag in ("html", "body", "main") or not raw.strip():
        return FINE
    said = FINE
    for m in _ATTR.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if tag == "article":
            if name == "class" and _OWN.search(value):
                return UNWANTED
        elif name in ("class", "id"):
            anchor = name == "id" and within
            found = _named(value, within, anchor)
            said = max(said, min(found, DOUBTFUL) if anchor and tag in _HEADING else found)
            if not within and _HEADER.search(value):
                return UNWANTED
        if (name == "role" and value.lower() in _ROLES and tag != "article") or (name == "hidden" and "until-found" not in value) or (name == "aria-hidden" and value == "true"):
            return UNWANTED
        if name == "style" and _HIDDEN.search(value):
            return UNWANTED
    return said


def _holds_articles(tag: str, raw: str) -> bool:
    """Whether an unwanted element may have articles of its own: comments, a sidebar and the like."""
    return tag == "aside" or any(m[1].lower() in ("class", "id") and _HOLDERS.search(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw))


def blocks(html: str) -> list[tuple[int, str]]:
    """(zone, text) in page order; zones: 3 a doubtful part of an article, 2 in an article or main element, 1 open, 0 boilerplate by its markup."""
    out, hidden = _blocks(html, False)
    return _blocks(html, True)[0] if hidden and not any(z >= 2 for z, _ in out) else out


def _blocks(html: str, every: bool) -> tuple[list[tuple[int, str]], bool]:
    """The blocks, and whether an article is out for what it is in; `every`: no article is."""
    out: list[tuple[int, str]] = []
    # tag, what it and what is around it say, in an article, whether an article within may be the page's
    stack: list[tuple[str, int, bool, bool]] = []
    open_tags: dict[str, int] = {}
    held: list[str] = []
    zone, hidden = 1, False

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                out.append((zone, text))
            held.clear()

    def close(i: int) -> None:
        for x in stack[i:]:
            open_tags[x[0]] -= 1
        del stack[i:]

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            held.append(unescape(html[at:]))
            break
        if m.start() > at:
            held.append(unescape(html[at : m.start()]))
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        tag, closing, raw = m[2].lower(), bool(m[1]), m[3] or ""
        if tag in _SPACE:
            held.append(" ")
        if tag in _BLOCK or tag in _CHROME:
            flush()
        if closing:
            if open_tags.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                close(i)
        elif tag not in _VOID:
            if tag in ("article", "main") and not (open_tags.get("article") or open_tags.get("main")):
                if every or all(x[3] for x in stack):
                    # an article isn't part of a menu or an advert: what is open there was never closed
                    stack = [x for x in stack if x[0] in ("html", "body") or x[1] == FINE]
                    open_tags = {}
                    for x in stack:
                        open_tags[x[0]] = open_tags.get(x[0], 0) + 1
                else:
                    hidden = True
            if tag == "p" and open_tags.get("p"):
                i = next((i for i in range(len(stack) - 1, max(-1, len(stack) - 5), -1) if stack[i][0] == "p"), -1)
                if i >= 0 and all(x[0] not in _BLOCK for x in stack[i + 1 :]):
                    close(i)
            around = stack[-1] if stack else ("", FINE, False, True)
            said = _judged(tag, raw, around[2])
            passes = around[3] and not (said == UNWANTED and _holds_articles(tag, raw))
            stack.append((tag, max(around[1], said), around[2] or tag in ("article", "main"), passes))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag in _RAW and not raw.rstrip().endswith("/"):
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                at = end.start() if end else n
        top = stack[-1] if stack else ("", FINE, False, True)
        now = 0 if top[1] == UNWANTED else (2 + (top[1] == DOUBTFUL)) if top[2] else 1
        if now != zone:
            flush()
            zone = now
    flush()
    return out, hidden


def window_hashes(host: str, stream: list[str], length: int) -> list[int]:
    """Of each run of `length` tokens of a block (the block, if shorter), a hash of it and the host."""
    seed = xxhash.xxh3_64_intdigest(host.encode())
    return [xxhash.xxh3_64_intdigest(" ".join(stream[i : i + length]).encode(), seed) for i in range(max(1, len(stream) - length + 1))]


def repeated(streams: list[list[str]], pages: list[int], length: int, least: int, known: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Of each token stream (a block of a page), which tokens a run of `length` tokens covers that `least` pages have; short blocks are covered as a whole.

    `known`: for each stream, its runs that other pages than these have often enough, in order of their starts.
    """
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    flat = [w for s in streams for w in s]
    coded = pa.array(flat, pa.string()).dictionary_encode()
    token = coded.indices.to_numpy().astype(np.int64) + 1 if flat else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(streams)), sizes)
    left = sizes[owner] - (np.arange(len(token)) - (np.cumsum(sizes) - sizes)[owner])
    page = np.asarray(pages, np.int64)[owner] if len(token) else token
    # suffixes by their first 2**k tokens, doubled until `length`; a suffix ends with its block
    rank, k = token.copy(), 1
    while k < length:
        nxt = np.zeros(len(rank), np.int64)
        nxt[: max(0, len(rank) - k)] = rank[k:]
        nxt[left <= k] = 0
        rank = np.unique(rank * (rank.max(initial=0) + 1) + nxt, return_inverse=True)[1] + 1
        k *= 2
    # a suffix shorter than that counts if it is its whole block
    whole = np.arange(len(token)) == (np.cumsum(sizes) - sizes)[owner]
    counts = (left >= length) | whole
    order = np.lexsort((page, rank))
    order = order[counts[order]]
    r, p = rank[order], page[order]
    fresh = np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1]))) if len(r) else np.empty(0, bool)
    on = np.bincount(r, fresh, minlength=int(rank.max(initial=0)) + 1)
    start = (on[rank] >= least) & counts
    if known is not None:
        for first, own in zip((np.cumsum(sizes) - sizes).tolist(), known):
            start[first : first + len(own)] |= own
    edge = np.zeros(len(token) + 1, np.int64)
    at = np.flatnonzero(start)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + np.minimum(left[at], length), -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.split(covered, np.cumsum(sizes)[:-1]) if len(streams) else []


def packed(page: list[tuple[int, str]]) -> tuple[int, bytes]:
    """Blocks compressed (their texts have no control characters), and their size before."""
    raw = "\x1f".join([f"{z}{t}" for z, t in page]).encode()
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(sizes, raw) -> list[list[tuple[int, str]]]:
    pages = [pa.decompress(r, n, codec="zstd", asbytes=True).decode() if n else "" for n, r in zip(sizes.to_pylist(), raw.to_pylist())]
    return [[(int(x[0]), x[1:]) for x in p.split("\x1f")] if p else [] for p in pages]


def settled(zones: list[list[int]], texts: list[list[str]], hosts: list[str], pages: list[int], hits: set[int] | None = None) -> list[str]:
    """The main texts of a shard's pages: open and doubtful blocks without what is repeated over its pages, or over its host's (`hits`: hashes of such runs)."""
    rows = [(i, k) for i, z in enumerate(zones) for k, x in enumerate(z) if x != 2]
    streams = [texts[i][k].split(" ") for i, k in rows]
    known = None if hits is None else [np.array([h >> 1 in hits for h in window_hashes(hosts[i], s, LENGTH)], bool) for (i, _), s in zip(rows, streams)]
    covered = repeated(streams, [pages[i] for i, _ in rows], LENGTH, PAGES, known)
    parts = [list(t) for t in texts]
    article = [any(x >= 2 for x in z) for z in zones]
    for (i, k), s, cov in zip(rows, streams, covered):
        # where there is an article, open blocks are only evidence
        asked = zones[i][k] == 3 or (zones[i][k] == 1 and not article[i])
        parts[i][k] = " ".join([w for w, c in zip(s, cov.tolist()) if not c]) if asked else ""
    return ["\n\n".join(filter(None, p)) for p in parts]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__host, __shard, h, page) of the runs of tokens that are evidence, of hosts with several shards."""
    for batch in batches:
        for i in range(0, batch.num_rows, 100):
            part = batch.slice(i, 100)
            part = part.filter(pc.greater(part.column("__k"), 1))
            pages = zip(part.column("__host").to_pylist(), unpacked(part.column("__size"), part.column("__packed")))
            found = [sorted({h >> 1 for z, t in page if z != 2 for h in window_hashes(x, t.split(" "), LENGTH)}) for x, page in pages]
            at = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]), pa.int64())
            h = pa.array([h for x in found for h in x], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("__host").take(at), part.column("__shard").take(at), h, part.column("__page").take(at)], ["__host", "__shard", "h", "page"])


def _digest(texts: list[str]) -> int:
    whole = xxhash.xxh64()
    for t in texts:
        whole.update(t.encode() + b"\0")
    return whole.intdigest() >> 1


def _parsed(df: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """The columns to keep, and the page's digest and its packed blocks in place of the html."""
    at, places = df.columns.index(html), [df.columns.index(k) for k in keep]
    own = df.select(*[F.col(f"`{k}`") for k in keep]).schema.fields
    made = {"__page": T.LongType(), "__size": T.LongType(), "__packed": T.BinaryType()}
    schema = T.StructType([*own, *(T.StructField(n, t) for n, t in made.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = [blocks(page or "") for page in part.column(at).to_pylist()]
                small = [packed(f) for f in found]
                columns = [pa.array([_digest([t for _, t in f]) for f in found], pa.int64()), pa.array([n for n, _ in small], pa.int64()), pa.array([x for _, x in small], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in places), *columns], [*keep, *made])

    return df.mapInArrow(run, schema)


def main_text(df: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, out: str = "text") -> DataFrame:
    """The columns to keep (all but the html by default) and the page's main text, blocks parted by an empty line."""
    # a column of the result's name is replaced; the operator's own names begin with two underscores
    keep = [c for c in ([c for c in df.columns if c != html] if keep is None else keep) if c != out]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    # the row's number: repeatable, as nothing is shuffled before it
    pages = df.withColumns({"__html": F.col(f"`{html}`"), "__host": host, "__row": F.monotonically_increasing_id()})
    large = pages.groupBy("__host").agg(F.ceil(F.sum(F.octet_length("__html")) / F.lit(SHARD_BYTES)).alias("__k")).where("__k > 1")
    several = large.count()
    if 0 < several <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    pages = pages.join(large, "__host", "left").withColumn("__k", F.coalesce("__k", F.lit(1))) if several else pages.withColumn("__k", F.lit(1).cast("long"))
    pages = pages.withColumn("__shard", F.pmod(F.xxhash64("__row"), F.col("__k")))
    parsed = _parsed(pages.select(*[F.col(f"`{k}`") for k in keep], "__host", "__k", "__shard", "__html"), "__html", [*keep, "__host", "__k", "__shard"])
    schema = T.StructType([*df.select(*[F.col(f"`{k}`") for k in keep]).schema.fields, T.StructField(out, T.StringType())])

    def settle(table: pa.Table, hits: pa.Table | None = None) -> pa.Table:
        found = unpacked(table["__size"], table["__packed"])
        zones, texts = [[z for z, _ in f] for f in found], [[t for _, t in f] for f in found]
        text = settled(zones, texts, table["__host"].to_pylist(), table["__page"].to_pylist(), set(hits["h"].to_pylist()) if hits is not None and len(hits) else None)
        return pa.table([*(table[k] for k in keep), pa.array(text, pa.string())], names=[*keep, out])

    if not several:
        return parsed.groupBy("__host", "__shard").applyInArrow(lambda t: settle(t), schema)
    dealt = parsed.repartition("__host", "__shard")  # one exchange for both uses
    # of hosts with several shards, the runs that enough pages of the host have; counted in two steps, so that a hot run is a few rows
    windows = dealt.mapInArrow(_windows, "__host string, __shard long, h long, page long")
    often = windows.select("h", "page").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    hits = windows.select("__host", "__shard", "h").distinct().join(often, "h", "left_semi").select("__host", "__shard", "h")
    return dealt.groupBy("__host", "__shard").cogroup(hits.groupBy("__host", "__shard")).applyInArrow(settle, schema)
