"""Main text of web pages by consensus paths of their host.

1. Each page is parsed into a tree of containers. A container's generalised path is the chain of its ancestors' tags with their
   classes, digits and everything after them stripped (``div.post-123`` → ``div.post``). A container is scored by the
   text of its own blocks outside links; a parent gains half of what its children hold.
2. The best containers are widened to the whole article: to the ``article`` (or else ``main``) element around them, else to the
   outermost ancestor that holds text of its own, or whose other parts hold a fifth as much text again. The widened
   containers vote for their paths; Spark sums the votes per host (partial sums first, so a host with a third of all
   pages is no bottleneck), and the path with the most votes wins the host.
3. Every page is extracted again below the winning path of its host, widened by the text around it in the same article. A
   page falls back to its own best container where it lacks the path, where the path yields under ``least`` of its own
   best, and where its own best is an ``article`` element of which the path yields under nine tenths.

Parsing is a single forward scan with a regular expression over tags, tolerant of unclosed and misnested tags: a block
tag closes an open paragraph, an end tag closes up to its opening tag, and an end tag without one is ignored. A page that
ends inside a tag or a comment keeps what came before. The tree is kept as parent numbers and path digests, so memory grows with
the page and not with its depth.

Left out: menus, headers, footers, sidebars, adverts, forms, scripts, styles and hidden elements by tag, role or attribute (a header
inside an article stays); and by the words of class and id sidebars, notices, adverts, share bars, reader comments and the like.
Names condemn no element that holds an ``article`` or ``main`` element, nor, on a page without one, four fifths of the text; inside an
article only those names count that never belong to it (``IN_ARTICLE``).

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones
dropped and the others joined in page order by a blank line.

Defined cases: null and empty html give an empty text; a page without any block outside boilerplate gives the text that only
names had condemned, or an empty text; ties between containers go to the earlier one, between paths to the smaller string; a
null or unparsable url is the host ""; repeated rows keep their rows; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, read_table, spread

# Element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style textarea title noscript template iframe svg noframes".split())
SKIPPED = frozenset("nav header footer aside form button select script style noscript template iframe svg title head dialog menu textarea object".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre "
    "section summary table tbody td tfoot th thead tr ul xmp".split()
)
CONTAINERS = frozenset("article main section div td body blockquote".split())
CLOSES_P = BLOCKS
COMMENTS = "comment comments disqus respond reply replies".split()
# Names that never belong to an article, wherever they stand.
IN_ARTICLE = (
    "ad ads advert advertisement adverts sponsor sponsored promo share sharing social related recommended recommendations cookie cookies consent gdpr newsletter "
    "subscribe subscription signup sidebar nav navbar navigation breadcrumb breadcrumbs pagination pager widget popup modal"
).split() + COMMENTS
BOILERPLATE = (
    IN_ARTICLE
    + "banner menu header masthead footer side aside notice notices overlay login form search tags toolbar skip copyright legal disclaimer".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*(?:>|\Z)|<(?=/?[a-zA-Z])[^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORDS = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_LAYOUT = re.compile(r"\b(?:has|no|with|without)[-_][a-z]+")
_NOT_NAME = re.compile(r"[^a-z_-].*", re.S)
_NAMES = {"comment": frozenset(COMMENTS), "always": frozenset(IN_ARTICLE), "outside": frozenset(BOILERPLATE)}
_LONG_BLOCK = 25


@dataclass
class Block:
    """A run of text, the node it lies in (-1: none) and how many of its characters are links."""

    text: str
    node: int
    linked: int


@dataclass
class Parsed:
    """The containers and named elements in page order (a parent before its children), and the blocks outside skipped elements."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    steps: list[str | None] = field(default_factory=list)  # of containers
    digests: list[int] = field(default_factory=list)  # of generalised paths
    kinds: list[str | None] = field(default_factory=list)  # which of _NAMES the class and id fall under
    blocks: list[Block] = field(default_factory=list)

    def add(self, tag: str, parent: int, step: str | None, kind: str | None) -> int:
        above = self.digests[parent] if parent >= 0 else 0
        self.tags.append(tag)
        self.parents.append(parent)
        self.steps.append(step)
        self.digests.append(above if step is None else path_digest(above, step))
        self.kinds.append(kind)
        return len(self.tags) - 1

    def path(self, node: int) -> str:
        """The generalised path of a container."""
        steps: list[str] = []
        while node >= 0:
            if self.steps[node] is not None:
                steps.append(self.steps[node])
            node = self.parents[node]
        return "/".join(reversed(steps))

    def totals(self, blocks: list[Block], least: int = 0) -> list[int]:
        """Characters outside links below each node, of blocks of at least ``least`` characters."""
        out = [0] * len(self.tags)
        for b in blocks:
            if b.node >= 0 and len(b.text) >= least:
                out[b.node] += max(0, len(b.text) - b.linked)
        for i in range(len(out) - 1, -1, -1):
            if self.parents[i] >= 0:
                out[self.parents[i]] += out[i]
        return out


def path_digest(above: int, step: str) -> int:
    """Digest of a path from its parent's digest."""
    low = zlib.crc32(step.encode(), above & 0xFFFFFFFF)
    return (above * 0x9E3779B97F4A7C15 + low + 1 & 0xFFFFFFFF) << 32 | low


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(raw)} if raw else {}


def _is_hidden(attributes: dict[str, str]) -> bool:
    if not attributes:
        return False
    if attributes.get("role") in ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return "style" in attributes and re.search(r"display\s*:\s*none", attributes["style"]) is not None


def _kind(tag: str, attributes: dict[str, str]) -> str | None:
    """Which kind of boilerplate the element's names speak of."""
    if not attributes or tag in ("body", "html", "main"):
        return None
    names = _LAYOUT.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}")
    words = set(_WORDS.findall(names))
    for kind, known in _NAMES.items():
        if words & known and (kind == "comment" or tag != "article"):
            return kind
    return None


def _step(tag: str, attributes: dict[str, str]) -> str:
    names = sorted({_NOT_NAME.sub("", c).rstrip("-_") for c in attributes.get("class", "").split()} - {""})
    return ".".join([tag, *names])


def parse(page: str | None) -> Parsed:
    """One forward scan of a page; what names condemn is decided by ``kept`` when the whole page is known."""
    page = page or ""
    out = Parsed()
    stack: list[tuple[str, int]] = []  # tag, node or -1
    open_: dict[str, int] = defaultdict(int)
    chain: list[int] = []
    parts: list[str] = []
    linked = skip = links = articles = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                out.blocks.append(Block(text, chain[-1] if chain else -1, linked))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not skip:
            parts.append(text)
            if links:
                linked += len(text)

    def close(upto: int) -> None:
        nonlocal skip, links, articles
        while len(stack) > upto:
            tag, node = stack.pop()
            open_[tag] -= 1
            if skip:
                skip -= 1
                continue
            if tag in BLOCKS or node >= 0:
                flush()
            if tag == "a":
                links = max(0, links - 1)
            if tag in ("article", "main"):
                articles -= 1
            if node >= 0:
                chain.pop()

    at = 0
    n = len(page)
    while at < n:
        match = _TAG.search(page, at)
        if match is None:
            say(page[at:])
            break
        say(page[at : match.start()])
        at = match.end()
        tag = match[2]
        if tag is None:
            continue
        tag = tag.lower()
        if match[1]:
            if not open_[tag]:
                if tag == "p" and not skip:
                    flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                if stack[i][0] in ("article", "main", "body", "table") and tag not in BLOCKS:
                    break
            continue
        raw = match[3]
        if tag == "br":
            say(" ")
            continue
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            if tag == "hr" and not skip:
                flush()
            continue
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in CONTAINERS or stack[i][0] in ("ul", "ol", "table", "tr", "li"):
                    break
        if tag == "xmp":
            end = re.compile(r"</xmp\s*>", re.I).search(page, at)
            if not skip:
                flush()
                say(page[at : end.start() if end else n].replace("&", "&amp;"))
                flush()
            at = end.end() if end else n
            continue
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in same:
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "tr" if tag != "tr" else "table", "div", "article", "main", "body"):
                    break
        if skip and tag in ("body", "main", "article"):
            # A head, menu or header that was never closed ends where the content begins.
            opened = len(stack) - skip
            if stack[opened][0] == "head" or tag != "body" and stack[opened][0] in ("nav", "header", "title"):
                close(opened)
        if skip:
            skip += 1
            open_[tag] += 1
            stack.append((tag, -1))
            continue
        attributes = _attributes(raw)
        if tag in SKIPPED and not (tag == "header" and articles) or _is_hidden(attributes):
            if tag in BLOCKS or tag in SKIPPED:
                flush()
            skip = 1
            open_[tag] += 1
            stack.append((tag, -1))
            continue
        kind = _kind(tag, attributes)
        if tag in BLOCKS or kind:
            flush()
        if tag == "a":
            links += 1
        if tag in ("article", "main"):
            articles += 1
        node = -1
        if tag in CONTAINERS or kind:
            node = out.add(tag, chain[-1] if chain else -1, _step(tag, attributes) if tag in CONTAINERS else None, kind)
            chain.append(node)
        open_[tag] += 1
        stack.append((tag, node))
    flush()
    return out


def kept(page: Parsed, most: float = 0.8) -> list[Block]:
    """The blocks that the names of their elements do not condemn; all of them if none were left."""
    nodes = range(len(page.tags))
    totals = page.totals(page.blocks)
    everything = sum(max(0, len(b.text) - b.linked) for b in page.blocks)
    articles = [tag in ("article", "main") and kind is None for tag, kind in zip(page.tags, page.kinds)]  # a reader's comment is none
    large = float("inf") if any(articles) else most * everything
    holds = [False] * len(page.tags)
    for i in reversed(nodes):
        if page.parents[i] >= 0 and (articles[i] or holds[i]):
            holds[page.parents[i]] = True
    within = [False] * len(page.tags)
    gone = [False] * len(page.tags)
    for i in nodes:
        above = page.parents[i]
        inside = above >= 0 and within[above]
        within[i] = inside or articles[i]
        kind = page.kinds[i]
        condemned = kind is not None and not holds[i] and totals[i] < large and not (inside and kind == "outside")
        gone[i] = condemned or above >= 0 and gone[above]
    left = [b for b in page.blocks if b.node < 0 or not gone[b.node]]
    return left or page.blocks


def container_scores(page: Parsed, blocks: list[Block]) -> dict[int, float]:
    """Score of each container: characters of its blocks outside links; a parent gains half of what its children hold.

    Long blocks count in full, short ones (menus that escaped the names) by a tenth.
    """
    scores: dict[int, float] = defaultdict(float)
    for block in blocks:
        size = len(block.text)
        value = max(0, size - 2 * block.linked) * (1.0 if size >= _LONG_BLOCK else 0.1)
        node, depth = block.node, 0
        while node >= 0 and depth < 3:
            if page.steps[node] is not None:
                scores[node] += value * 0.5**depth
                depth += 1
            node = page.parents[node]
    return scores


class Regions:
    """Widening of containers to the article around them."""

    def __init__(self, page: Parsed, blocks: list[Block]) -> None:
        self.page = page
        self.totals = page.totals(blocks, _LONG_BLOCK)
        self.direct = [False] * len(page.tags)
        for b in blocks:
            node = b.node
            while node >= 0 and page.steps[node] is None:
                node = page.parents[node]
            if node >= 0 and b.linked < len(b.text):
                self.direct[node] = True
        # The outermost article or, outside of articles, main element around each node.
        self.article = [-1] * len(page.tags)
        for i, tag in enumerate(page.tags):
            above = page.parents[i]
            outer = self.article[above] if above >= 0 else -1
            if outer < 0 or page.tags[outer] == "main" and tag == "article":
                outer = i if tag in ("article", "main") else outer
            self.article[i] = outer

    def widened(self, node: int, share: float | None = 0.2) -> int:
        """The article around a container; ``share``: how much text an ancestor's other parts must add (None: only its own text counts)."""
        if self.article[node] >= 0:
            return self.article[node]
        best, at = node, self.page.parents[node]
        while at >= 0:
            if self.page.steps[at] is not None:
                adds = share is not None and self.totals[at] - self.totals[best] >= max(1, share * self.totals[best])
                if adds or self.direct[at] and self.page.tags[at] != "body":
                    best = at
            at = self.page.parents[at]
        return best


def _best_roots(page: Parsed, blocks: list[Block], most: int) -> dict[int, float]:
    """The widened best containers, best first, with their share of the best score."""
    scores = container_scores(page, blocks)
    best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:most]
    if not best or best[0][1] <= 0:
        return {}
    regions = Regions(page, blocks)
    out: dict[int, float] = {}
    for container, score in best:
        out.setdefault(regions.widened(container), score / best[0][1])
    return out


def votes(page: Parsed, most: int = 3) -> list[tuple[str, float]]:
    """(path, share of the page's best score) of its best containers, widened; paths that occur twice in a page add up."""
    out: dict[str, float] = defaultdict(float)
    for root, share in _best_roots(page, kept(page), most).items():
        out[page.path(root)] += share
    return sorted(out.items())


def below(page: Parsed, blocks: list[Block], roots: set[int]) -> list[str]:
    """Texts of the blocks below some nodes, in page order."""
    inside = [False] * len(page.tags)
    for i in range(len(inside)):
        inside[i] = i in roots or page.parents[i] >= 0 and inside[page.parents[i]]
    return [b.text for b in blocks if b.node >= 0 and inside[b.node]]


def extract(page: str | None, path: str | None, least: float = 0.3) -> str:
    """The page's main text below ``path``, or below its own best container (see above)."""
    parsed = parse(page)
    blocks = kept(parsed)
    size = lambda texts: sum(map(len, texts))
    texts: list[str] = []
    if path is not None:
        digest = 0
        for step in path.split("/"):
            digest = path_digest(digest, step)
        regions = Regions(parsed, blocks)
        matches = {i for i, d in enumerate(parsed.digests) if d == digest and parsed.steps[i] is not None}
        texts = below(parsed, blocks, {regions.widened(i, None) for i in matches})
    own_roots = list(_best_roots(parsed, blocks, 1))
    own = below(parsed, blocks, set(own_roots))
    needed = 0.9 if own_roots and parsed.tags[own_roots[0]] == "article" else least
    if size(texts) < needed * size(own):
        texts = own
    if not texts:
        texts = [b.text for b in blocks]
    return "\n\n".join(texts)


def host(url: str = "url") -> F.Column:
    """Lower-cased host of a url without port and leading www or m."""
    name = F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?(?:www\.|m\.)?([^/:?#]+)", 1)
    return name


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with the most votes of each host."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths, shares = [], [], []
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            for path, share in votes(parse(page.as_py())):
                hosts.append(name), paths.append(path), shares.append(round(share * 1000))
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.int64())], ["host", "path", "share"])

    cast = map_batches(pages.select(host().alias("host"), "html"), "host string, path string, share long", run)
    sums = cast.groupBy("host", "path").agg(F.sum("share").alias("share"))
    first = Window.partitionBy("host").orderBy(F.col("share").desc(), "path")
    return sums.withColumn("place", F.row_number().over(first)).where("place = 1").select("host", "path")


def extract_pages(pages: DataFrame, broadcast_hosts: int = 50_000) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages``.

    The winners, one short row per host, are broadcast while there are at most ``broadcast_hosts`` of them (counted first);
    beyond that they are joined by shuffle, where adaptive execution splits a host that holds too many pages.
    """
    from .common import materialise

    winners = materialise(winning_paths(pages), "host-paths").select(F.col("host").alias("known"), "path")
    if winners.count() <= broadcast_hosts:
        winners = F.broadcast(winners)
    rows = pages.select("page_id", "url", "html", host().alias("host")).join(winners, F.col("host") == F.col("known"), "left").select("page_id", "url", "html", "path")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(page.as_py(), path) for page, path in zip(batch.column(2), batch.column(3).to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(rows, "page_id long, url string, text string, n_chars long", run)


def op7_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(spread(read_table(spark, sf_dir, "pages"), "page_id"))
