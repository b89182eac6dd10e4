"""Main text of HTML pages: structure first, then a suffix array per host.

Pages of a host are split into shards of some megabytes. In a shard the token streams of all pages
are concatenated and a suffix array, sorted to the depth of ``MIN_TOKENS``, groups the positions that
start the same long substring. Substrings found on ``MIN_PAGES`` distinct pages are boilerplate:
covered tokens go, the unique runs between them stay. The shards of a larger host send the hashes of
their substrings of that length with page counts to buckets, which add them up over the host and
answer with one bit per hash; the same tokens then go as if the host were one shard. Text inside an article or main element is
content even where other pages repeat it; whether it is all of the content is decided by what the repeats leave around it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from onefold.llm.backoff import from_small, from_sorted, small_numbers, sorted_hashes
from onefold.llm.packs import BUCKET_KEYS, numbers
from onefold.llm.tokens import joined, window_hashes, words_of
from onefold.session import settle, small_side

MIN_TOKENS = 8
MIN_PAGES = 5
SHARD_BYTES = 4_000_000
# Article and main elements are the text of the page if they hold this share of what repeats leave around them.
MAIN_SHARE = 0.5
# Bytes of a page per word assumed when buckets are numbered; affects their size only.
_BYTES_PER_WORD = 6

MAIN, BODY, CHROME = 2, 1, 0

# Fixed names of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROPPED = frozenset(
    "script style textarea title xmp iframe noembed noframes head nav header footer aside form button select "
    "option datalist template svg math canvas object audio video dialog menu noscript map fieldset label".split()
)
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
_KEPT_NAMES = frozenset({"html", "body", "main", "article"})
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^>\"'])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?(?=[\s/]|$)", re.I)
_CHROME_NAME = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisements?|advertising|adsense|banners?|sponsors?|sponsored|promos?|promotions?|cookies?|consent|gdpr|"
    r"notices?|alerts?|popups?|modals?|overlay|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|side-bar|footers?|headers?|masthead|"
    r"comments?|commentlist|respond|disqus|replies|related|recommended|share|sharing|social|newsletters?|subscribe|signup|login|"
    r"search|widgets?|pagination|pager|toolbar|skip-link|copyright|disclaimer)(?![a-z])",
    re.I,
)


# Fixed words that leave the meaning of a class name as it is.
_NEUTRAL = frozenset(
    "area article articles bar block bottom box button buttons col column container content desktop fixed form group icon icons inner item "
    "items js large left link links list main mobile module new outer page panel post posts primary right row secondary section site slot "
    "small sticky text top unit wrap wrapper".split()
)


def _names_chrome(value: str, inside: bool) -> bool:
    """Whether class or id names say chrome; inside the main text a name must hold no other meaning (``related-work`` is kept)."""
    if not inside:
        return bool(_CHROME_NAME.search(value))
    for token in value.split():
        parts = [p for p in re.split(r"[^a-zA-Z]+", token) if p]
        if _CHROME_NAME.search(token) and all(_CHROME_NAME.fullmatch(p) or p.lower() in _NEUTRAL for p in parts):
            return True
    return False


def _is_chrome(name: str, attributes: str, inside: bool = False) -> bool:
    if name in _DROPPED:
        return True
    if not attributes:
        return False
    for found in _ATTRIBUTE.finditer(attributes):
        key, value = found[1].lower(), (found[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if key == "role" and value in _ROLES:
            return True
        if key in ("class", "id"):
            spaced = re.sub(r"([a-z])([A-Z])", r"\1-\2", (found[2] or "").strip("\"'"))
            if name not in _KEPT_NAMES and _names_chrome(spaced, inside):
                return True
            if name == "article" and re.search(r"(?<![a-z])comments?(?![a-z])", spaced, re.I):
                return True
    return False


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(zone, text) of the blocks of a page in order; zone is MAIN, BODY or CHROME."""
    blocks: list[tuple[int, str]] = []
    pieces: list[str] = []
    # Open blocks and chrome elements (name, starts chrome, starts the main text), how many of each name, and open inline elements.
    stack: list[tuple[str, bool, bool]] = []
    open_names: dict[str, int] = {}
    inline: dict[str, int] = {}
    bases: dict[str, list[int]] = {}  # open inline elements of the name where a chrome element of it began
    chrome = main = 0

    def close_block() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append((CHROME if chrome else MAIN if main else BODY, text))
            pieces.clear()

    def pop_to(depth: int) -> None:
        nonlocal chrome, main
        if any(x[1] or x[2] or x[0] in _BLOCK for x in stack[depth:]):
            close_block()
        for name, c, m in stack[depth:]:
            chrome -= c
            main -= m
            open_names[name] -= 1
            if name not in _BLOCK:
                bases[name].pop()
        del stack[depth:]

    at = 0
    while True:
        found = _TAG.search(html, at)
        text = html[at:found.start() if found else len(html)]
        if text:
            pieces.append(unescape(text))
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            continue
        closing, attributes = found[1] or found[4], found[3] or found[6] or ""
        if closing:
            if name in _BLOCK:
                close_block()
            elif inline.get(name, 0) > (bases[name][-1] if bases.get(name) else 0):
                inline[name] -= 1
                continue
            if open_names.get(name):
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == name:
                        pop_to(depth)
                        break
            continue
        if name in _BLOCK:
            close_block()
            for depth in range(len(stack) - 1, -1, -1):
                open_name = stack[depth][0]
                if open_name == "p" or open_name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                    pop_to(depth)
                    break
                if open_name in _BLOCK:
                    break
        if name == "br" or name == "hr":
            pieces.append(" ")
        if name in _RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>|\Z", re.I).search(html, at)
            at = end.end()
            continue
        if name in _VOID or attributes.endswith("/") and name not in _BLOCK:
            continue
        is_chrome = _is_chrome(name, attributes, main > 0)
        is_main = name in ("article", "main") and not is_chrome
        if is_chrome and name not in _BLOCK:
            close_block()
        if name not in _BLOCK and not is_chrome:
            # Inline elements change no zone: only how many are open where is kept, so that there may be any number.
            inline[name] = inline.get(name, 0) + 1
            continue
        stack.append((name, is_chrome, is_main))
        open_names[name] = open_names.get(name, 0) + 1
        if name not in _BLOCK:
            bases.setdefault(name, []).append(inline.get(name, 0))
        chrome += is_chrome
        main += is_main
    close_block()
    return blocks


def suffix_groups(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of the suffix at each position by its first ``depth`` tokens, by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    held = 1
    while held < depth:
        step = min(held, depth - held)
        later = np.full(len(rank), -1, np.int64)
        later[:-step] = rank[step:]
        rank = np.unique(rank * (len(rank) + 1) + later + 1, return_inverse=True)[1].astype(np.int64)
        held += step
    return rank


def covered_tokens(tokens: np.ndarray, page: np.ndarray, depth: int, pages: int) -> np.ndarray:
    """Mask of the tokens in a substring of ``depth`` tokens that starts on ``pages`` distinct pages."""
    n = len(tokens)
    if n < depth:
        return np.zeros(n, bool)
    # A token of its own after every page keeps substrings inside pages.
    gap = np.flatnonzero(np.concatenate((page[1:] != page[:-1], [True]))) + 1
    place = np.arange(n) + np.searchsorted(gap, np.arange(n), side="right")
    stream = np.empty(n + len(gap), np.uint64)
    between = np.ones(len(stream), bool)
    between[place] = False
    _, code = np.unique(tokens, return_inverse=True)
    stream[place] = code
    stream[between] = np.arange(len(gap)) + n
    rank = suffix_groups(stream, depth)[place]
    seen = np.unique(np.stack((rank, page)), axis=1)[0]
    many = np.bincount(seen, minlength=rank.max() + 1) >= pages
    starts = np.flatnonzero(many[rank])
    last = gap[np.searchsorted(gap, starts, side="right")]
    starts = starts[starts + depth <= last]
    return _spread(starts, depth, n)


def _spread(starts: np.ndarray, depth: int, n: int) -> np.ndarray:
    """Mask of the ``n`` tokens in a substring of ``depth`` tokens that begins at one of the starts."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + depth, minlength=n + 1)
    return np.cumsum(step)[:-1] > 0


class _Pages:
    """Blocks of the pages of a shard, and the tokens outside their main text as one stream."""

    def __init__(self, rows: pa.Table):
        self.blocks = [blocks_of(x or "") for x in rows["html"].to_pylist()]
        stream, page, self.place = [], [], {}
        for i, blocks in enumerate(self.blocks):
            for k, (zone, text) in enumerate(blocks):
                if zone != MAIN:
                    self.place[i, k] = len(stream)
                    stream.append(text)
                    page.append(i)
        self.words = words_of(pa.array(stream, pa.large_string()))
        self.tokens = self.words.hashes()
        self.page = np.repeat(np.array(page, np.int64), self.words.counts())

    def windows(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of every run of ``depth`` tokens inside a page."""
        inside = max(0, len(self.page) - depth + 1)
        at = np.flatnonzero(self.page[:inside] == self.page[len(self.page) - inside:])
        return at, window_hashes(self.tokens, depth)[at]

    def distinct(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct window hashes, rising, and on how many pages each is."""
        at, hashes = self.windows(depth)
        page = self.page[at]
        order = np.lexsort((page, hashes))
        hashes, page = hashes[order], page[order]
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[1:] != hashes[:-1]) | (page[1:] != page[:-1])
        return np.unique(hashes[first], return_counts=True)


def _runs(keys: np.ndarray, shards: int, shard_bytes: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of rising keys; as many buckets as the size of the host asks for."""
    if not len(keys):
        return
    bits = max(1, math.ceil(math.log2(max(1, shards * shard_bytes / (_BYTES_PER_WORD * BUCKET_KEYS)))))
    present, begin = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    for bucket, a, b in zip(present, begin, np.append(begin[1:], len(keys)), strict=True):
        yield int(bucket), int(a), int(b)


def _ask(depth: int, shard_bytes: int) -> Callable:
    """Window hashes of a shard with their pages, if its host has other shards."""
    def run(rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in _REQUEST.names}
        shards = rows["shards"][0].as_py()
        if shards > 1:
            keys, counts = _Pages(rows).distinct(depth)
            for bucket, a, b in _runs(keys, shards, shard_bytes):
                values = (rows["host"][0].as_py(), bucket, rows["shard"][0].as_py(), sorted_hashes(keys[a:b]), small_numbers(counts[a:b]))
                for name, value in zip(_REQUEST.names, values, strict=True):
                    out[name].append(value)
        return pa.table(out, schema=_REQUEST)
    return run


def _answer(min_pages: int) -> Callable:
    """For each shard: which of its hashes are on ``min_pages`` pages of the host."""
    def run(requests: pa.Table) -> pa.Table:
        keys = [from_sorted(x) for x in requests["hashes"]]
        counts = joined([from_small(x, len(k)) for x, k in zip(requests["counts"], keys, strict=True)], np.int64)
        _, of = np.unique(joined(keys, np.uint64), return_inverse=True)
        many = (np.bincount(of, weights=counts) >= min_pages)[of]
        bounds = np.cumsum([0, *(len(k) for k in keys)])
        flags = [np.packbits(many[a:b]).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.table({"host": requests["host"], "shard": requests["shard"], "bucket": requests["bucket"], "many": pa.array(flags, pa.binary())})
    return run


def _covered(pages: _Pages, answers: pa.Table, shards: int, depth: int, shard_bytes: int) -> np.ndarray:
    """Mask of the covered tokens by the answers for the whole host."""
    if not len(pages.tokens):
        return np.zeros(0, bool)
    keys, _ = pages.distinct(depth)
    flags = {b.as_py(): numbers(x, np.uint8) for b, x in zip(answers["bucket"], answers["many"], strict=True)}
    many = np.zeros(len(keys), bool)
    for bucket, a, b in _runs(keys, shards, shard_bytes):
        many[a:b] = np.unpackbits(flags[bucket], count=b - a).astype(bool)
    at, hashes = pages.windows(depth)
    starts = at[many[np.searchsorted(keys, hashes)]]
    return _spread(starts, depth, len(pages.tokens))


def _extract(depth: int, min_pages: int, shard_bytes: int) -> Callable:
    def run(rows: pa.Table, answers: pa.Table | None = None) -> pa.Table:
        pages = _Pages(rows)
        shards = rows["shards"][0].as_py()
        if shards > 1:
            covered = _covered(pages, answers, shards, depth, shard_bytes)
        else:
            covered = covered_tokens(pages.tokens, pages.page, depth, min_pages)
        texts = []
        words = pages.words
        for i, blocks in enumerate(pages.blocks):
            kept, around = [], 0
            for k, (zone, text) in enumerate(blocks):
                if zone == MAIN:
                    kept.append((zone, text))
                if zone == BODY:
                    j = pages.place[i, k]
                    span = range(words.first[j], words.first[j + 1])
                    if covered[span.start:span.stop].any():
                        text = " ".join(words.bytes_of(w).decode() for w in span if not covered[w])
                    if text:
                        kept.append((zone, text))
                        around += len(text)
            inside = sum(len(text) for zone, text in kept if zone == MAIN)
            alone = inside and inside >= MAIN_SHARE * around
            texts.append("\n\n".join(text for zone, text in kept if zone == MAIN or not alone))
        return pa.table({
            "page_id": rows["page_id"], "url": rows["url"], "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "n_blocks": pa.array([len(b) for b in pages.blocks], pa.int64()),
        })
    return run


_REQUEST = pa.schema([("host", pa.string()), ("bucket", pa.int32()), ("shard", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def main_text(
    pages: DataFrame, min_tokens: int = MIN_TOKENS, min_pages: int = MIN_PAGES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points), n_blocks (all blocks of the page).

    Blocks are joined by two line feeds, white space inside a block is one space, character references
    are decoded. Menus, headers, footers, asides, forms, adverts, notices, comments and hidden parts go
    by element, role, class or id; inside an article a class or id name must mean nothing else. Outside of article and main
    elements the tokens covered by substrings of ``min_tokens`` tokens found on ``min_pages`` pages of the host go as well.
    What is then left around them is dropped too where they hold at least half as many characters; else (a page
    with teaser cards, say) it is kept.

    A null or empty html gives an empty text. Pages without a url are a host of their own. Repeated
    rows are pages of their own, each with a row of the result. Large hosts are split by hash into
    shards of about ``shard_bytes``, whose page counts are added up. Other columns are not read.
    """
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    sizes = rows.groupBy("host").agg(F.sum(F.octet_length("html").cast("long")).alias("size"))
    large = settle(sizes.where(F.col("size") > shard_bytes).select("host", F.ceil(F.col("size") / shard_bytes).alias("shards")))
    dealt = rows.join(small_side(large), "host", "left")
    shards = F.coalesce("shards", F.lit(1).cast("long"))
    dealt = dealt.select("host", F.pmod(F.xxhash64("page_id", "url"), shards).alias("shard"), shards.alias("shards"), "page_id", "url", "html")
    extract = _extract(min_tokens, min_pages, shard_bytes)
    result = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_blocks long"
    each = dealt.groupBy("host", "shard")
    if large.isEmpty():
        return each.applyInArrow(lambda rows: extract(rows), result)
    # All shards are grouped here, so that the pages are shuffled once for both passes.
    requests = each.applyInArrow(_ask(min_tokens, shard_bytes), "host string, bucket int, shard long, hashes binary, counts binary")
    replies = requests.groupBy("host", "bucket").applyInArrow(_answer(min_pages), "host string, shard long, bucket int, many binary")
    return each.cogroup(replies.groupBy("host", "shard")).applyInArrow(lambda rows, answers: extract(rows, answers), result)
