"""Main text of web pages by consensus on container paths.

Each page's containers are scored by the text of their blocks, less that of
links, fading with distance.  The path of the best one, as tags with their
first class without digits, is the page's vote.  Votes are summed per host and
path in Spark; then every page is extracted again under the first of its host's
winning paths that covers at least half of what its own best container does,
else under its own.  Boilerplate subtrees do not count, unless one shows that it
holds the article: several blocks of sentences with few links, where the rest of
the page has no sentence.  Comments, consent notices and navigation never do, so
a page that has nothing but boilerplate has no text.

Everything is linear in the page's length, nesting included: containers are nodes
of a tree of paths, and scores and choices are passed along it once.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxgrid.llm import common

#: A path wins on a host with at least this share of its votes; so at most 1 / share do.
LEAST_VOTES = 0.05
FADE = 0.7

#: A tag ends at the next "<", but for a few within a quoted value, so that unclosed tags and quotes are not scanned again and again.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|textarea|xmp|object|canvas|video|audio)\b[^<>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^<>\"']++|\"[^\"<]*+(?:<[^\"<]*+){0,8}\"|'[^'<]*+(?:<[^'<]*+){0,8}')*+)/?>|<(/?)([a-zA-Z][\w:-]*+)([^<>]*+)>|<[!?/][^<>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
_CONTAINER = frozenset("article aside blockquote body center details div dl figure main ol section table tbody td ul".split())
_DROPPED = frozenset("nav footer aside button select option head title dialog menu label input".split())
_BONUS = {"article": 1.6, "main": 1.4}
_CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"])}
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer header masthead sidebar "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist "
    "respond reply replies disqus widget toolbar pagination pager skip search form copyright paywall toast".split()
)
#: Noise that an article may be wrapped in by name, and words that only say what a part has or can do.
_HINTS = frozenset("ad ads advert sponsor sponsored promo promotion banner header notice alert share sharing social related recommended subscribe subscription signup login search form widget toolbar overlay modal popup skip copyright paywall toast".split())
#: Noise that is never the article, whatever it holds.
_NEVER = frozenset("comment comments commentlist respond reply replies disqus cookie cookies consent gdpr".split())
_STATES = frozenset("enabled disabled has have no non with without free ready loaded active on off is able allow allowed supports".split())
_OWN = frozenset("article entry post content story main title body".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")


#: How firmly a subtree is left out: not at all, unless it shows an article, unless nothing hinted at does, always.
KEPT, HINTED, FIRM, ALWAYS = range(4)


def _drop(tag: str, attributes: dict[str, str], inside: bool) -> int:
    if tag in _DROPPED or tag == "header" and not inside:
        return ALWAYS
    if not attributes:
        return FIRM if tag == "form" else KEPT
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return ALWAYS
    if attributes.get("role", "").lower() in _ROLES:
        return FIRM if tag == "form" else ALWAYS
    if tag in ("body", "html", "article", "main"):
        return KEPT
    out = FIRM if tag == "form" else KEPT
    for name in ("class", "id"):
        for one in attributes.get(name, "").split():
            words = set(_WORD.findall(_CAMEL.sub(" ", one).lower()))
            noise = words & _NOISE
            if noise and not words & _STATES and not (words & _OWN and words & {"header"}):
                out = max(out, ALWAYS if noise & _NEVER else HINTED if noise <= _HINTS else FIRM)
    return out


def _sentence(text: str) -> bool:
    """Whether a block reads like prose: three words or more that end as sentences do."""
    return text.count(" ") >= 2 and text.rstrip("\"'”’»)").endswith((".", "!", "?", "…", "。", "！", "？"))


class Page:
    """A page's blocks: container, text, characters of it in links, and the dropped subtree that each is in (0: none)."""

    def __init__(self) -> None:
        self.names, self.parents = [""], [-1]  # of containers; those with the same path are one
        self.blocks: list[tuple[int, str, int, int]] = []
        self.drops: list[tuple[int, int]] = [(0, KEPT)]  # (outer dropped subtree, firmness)
        self._children: dict[tuple[int, str], int] = {}

    def child(self, parent: int, name: str) -> int:
        node = self._children.setdefault((parent, name), len(self.names))
        if node == len(self.names):
            self.names.append(name)
            self.parents.append(parent)
        return node

    def find(self, path: str) -> int | None:
        node: int | None = 0
        for name in path.split(">") if path else ():
            node = self._children.get((node, name))
            if node is None:
                return None
        return node

    def path(self, node: int) -> str:
        out = []
        while node > 0:
            out.append(self.names[node])
            node = self.parents[node]
        return ">".join(reversed(out))

    def settle(self) -> None:
        """Forget the blocks of dropped subtrees, but for those that show the article."""
        if len(self.drops) > 1:
            n = len(self.drops)
            worth, linked, sentences = [0] * n, [0] * n, [0] * n
            for _, text, link, drop in self.blocks:
                worth[drop] += max(len(text) - link, 0)
                linked[drop] += link
                sentences[drop] += _sentence(text) and 2 * link < len(text)
            # with an unmarked article beside it, only a far longer text of several sentences is another part of it
            most = 20 * worth[0] if sentences[0] else 0
            shows = [k for k in range(1, n) if sentences[k] >= (5 if sentences[0] else 3) and worth[k] >= max(4 * linked[k], most)]
            back = {k for k in shows if self.drops[k][1] == HINTED}
            if not back and not sentences[0] and shows:
                back = {max(shows, key=lambda k: (worth[k], -k))}
            self.blocks = [b for b in self.blocks if b[3] == 0 or b[3] in back]

    def best(self) -> tuple[int | None, list[float]]:
        """The container with the highest score, the nearer to the root at a tie, and all scores."""
        if not self.blocks:
            return None, []
        score, depth = [0.0] * len(self.names), [0] * len(self.names)
        for node, text, link, _ in self.blocks:
            score[node] += max(len(text) - 2 * link, 0) + (20 if len(text) > 80 and not link else 0)
        for node in range(len(score) - 1, 0, -1):
            score[self.parents[node]] += FADE * score[node]
        for node in range(1, len(depth)):
            depth[node] = depth[self.parents[node]] + 1
        return max(range(len(score)), key=lambda k: (score[k] * _BONUS.get(self.names[k].split(".")[0], 1.0), -depth[k], self.names[k])), score

    def under(self, node: int) -> list[str]:
        """The texts of all blocks in a container."""
        held = [False] * len(self.names)
        held[node] = True
        for k in range(node + 1, len(held)):
            held[k] = held[self.parents[k]]
        return [text for k, text, _, _ in self.blocks if held[k]]


def parse(html: str) -> Page:
    """The page's blocks in page order, boilerplate settled."""
    page = Page()
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it is a container, whether it opened a dropped subtree
    open_: dict[str, int] = defaultdict(int)  # how many of each tag are open
    parts: list[str] = []
    node = drop = always = links = link_chars = at = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                page.blocks.append((node, text, min(link_chars, len(text)), drop))
            parts.clear()
        link_chars = 0

    def pop() -> None:
        nonlocal node, drop, always, links
        tag, container, opened = stack.pop()
        open_[tag] -= 1
        if tag in _BLOCK or opened:
            flush()
        if container:
            node = page.parents[node]
        if opened:
            if always:
                always -= 1
            else:
                drop = page.drops[drop][0]
        if tag == "a":
            links -= 1

    def text(piece: str) -> None:
        nonlocal link_chars
        if piece and not always:
            parts.append(piece)
            if links:
                link_chars += len(piece.strip())

    for m in _TOKEN.finditer(html):
        text(html[at : m.start()])
        at = m.end()
        tag = m.group(3) or m.group(6)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(2) or m.group(5):
            if tag == "br":
                text(" ")
            elif open_[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        raw = m.group(4) if m.group(3) else m.group(7)
        if tag in _VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                text(" ")
            continue
        closes = _CLOSES.get(tag, frozenset())
        if tag in _BLOCK:
            closes = closes | {"p"}
        if any(open_[t] for t in closes):
            scope = _SCOPES.get(tag, _CONTAINER if tag != "p" else frozenset())
            k = len(stack) - 1
            while k >= 0 and stack[k][0] not in closes and stack[k][0] not in scope:
                k -= 1
            if k >= 0 and stack[k][0] in closes:
                while len(stack) > k:
                    pop()
        attributes = {a.group(1).lower(): (a.group(2) or "").strip("\"'") for a in _ATTRIBUTE.finditer(raw)} if raw else {}
        firm = KEPT if always else _drop(tag, attributes, bool(open_["article"] or open_["main"]))
        opened = firm > KEPT
        if tag in _BLOCK or opened:
            flush()
        elif tag in ("td", "th"):
            text(" ")
        container = tag in _CONTAINER
        stack.append((tag, container, opened))
        open_[tag] += 1
        if container:
            first = _DIGITS.sub("", attributes.get("class", "").split(" ")[0]).replace(">", "")
            node = page.child(node, f"{tag}.{first}" if first else tag)
        if opened:
            if firm == ALWAYS:
                always += 1
            else:
                page.drops.append((drop, firm))
                drop = len(page.drops) - 1
        links += tag == "a"
    text(html[at:])
    flush()
    page.settle()
    return page


def extract(html: str | None, winners: list[str] | None = None) -> str:
    """The page's main text under the winning paths, one block per line."""
    page = parse(html or "")
    own, score = page.best()
    if own is None:
        return ""
    for name in winners or ():
        node = page.find(name)
        if node is not None and score[node] >= 0.5 * score[own]:
            own = node
            break
    return "\n".join(page.under(own))


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:]*?://([^/?#]*)", 1)), F.lit(""))


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hosts, votes = batch.column(0).to_pylist(), defaultdict(int)
        html = common.as_string(batch, "html")
        for host, text in zip(hosts, html, strict=True):
            page = parse(text.as_py())
            own, _ = page.best()
            if own is not None:
                votes[host, page.path(own)] += 1
        yield pa.RecordBatch.from_pydict({"host": [h for h, _ in votes], "path": [p for _, p in votes], "votes": list(votes.values())}, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("votes", pa.int64())]))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        html = common.as_string(batch, "html")
        texts = [extract(page.as_py(), paths) for page, paths in zip(html, batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty html gives an empty text; a null url is of the host ''.
    Repeated rows are extracted each; other columns are not read; an empty table
    gives no rows.
    """
    pages = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host"))
    votes = pages.select(F.col("_host").alias("host"), "html").mapInArrow(_voted, "host string, path string, votes long")
    votes = common.materialise(votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")), "votes")
    total = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(total, "host").where(F.col("votes") >= LEAST_VOTES * F.col("total"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("n"), "path")))  # at most 1 / LEAST_VOTES a host
    won = common.materialise(won.groupBy("host").agg(F.transform(order, lambda x: x["path"]).alias("_paths")).withColumnRenamed("host", "_host"), "won")
    joined = common.small_join(pages, won, ["_host"], "left")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "_paths").mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(common.table(spark, sf_dir, "pages"))
