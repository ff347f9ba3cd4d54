"""Main-text extraction: parser events, text-to-tag ratio per line, Gaussian smoothing, clusters.

The standard library's HTML parser is fed once; its events fill *lines*, one per block of the page, each
with its text, the tags met in it, its container and its noise. The text-to-tag ratios of the lines are
smoothed by a Gaussian; lines above a threshold (the deviation of the smoothed ratios) form clusters, which
choose the content region: of the article-like containers that hold over half of the clustered text, the
innermost of the highest rank; else the innermost container of any kind that holds ``MOST`` of it; else the lines from the
first to the last cluster. Where the container is of no known kind, its lines before the first and after the last
cluster go, but for headings and paragraphs.

Tags are a prior. What can't be content (menus, forms, scripts, adverts, comments) has the ratio 0 and stays
out. Names that are ambiguous (share, social, header, notice, ...) halve a line's ratio, and it stays out
unless it belongs to a cluster all the same, by its own ratio and the smoothed one. A header inside the article is the article's.

Defined results: a null or empty page, and one without text, gives an empty text; unclosed and stray tags are
tolerated; repeated rows are extracted again each; an empty table gives no rows; further columns are ignored. Texts
of any length are kept whole; a page takes memory in proportion to its own size, whatever its depth.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from . import arrays as A

#: Elements that break lines, that hold no content, and that never close.
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIP = set("aside button canvas datalist dialog embed fieldset footer form head header iframe input map menu nav noscript object option script select style svg template textarea title".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": BLOCK - {"body", "html", "head", "title"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
NAMED = r"(?:^|[\s_-])(?:%s)(?:$|[\s_-])"
HARD = re.compile(NAMED % r"ads?|advert\w*|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|login|menu|modal|nav\w*|newsletter|pagination|pager|popup|replies|sidebar|signup|skip|sponsor\w*|subscribe|toolbar", re.I)
SOFT = re.compile(NAMED % r"banner|copyright|disclaimer|header|masthead|notices?|promo\w*|related|share|sharing|social|widgets?", re.I)
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article|content|entry|main|post|story)(?:$|[\s_-])", re.I)
SPACES = re.compile(r"\s+")
CONTAINERS = set("article body div main section table tbody td tr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Share of the clustered text that a container without a known kind must hold.
MOST = 0.9


class Events(HTMLParser):
    """Lines of one page: [text parts, tags, container, noise (0 none, 1 ambiguous, 2 certain), block's tag]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # tag, noise, container or -1
        self.lines: list[list] = []
        self.containers: list[tuple[int, int, int]] = []  # parent container, rank, depth
        self.tags = 0
        self.fresh = True

    def _break(self):
        self.fresh = True

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.handle_data(" ")
            elif tag == "hr":
                self._break()
            return
        while self.stack and tag in CLOSES.get(self.stack[-1][0], ()):
            self.stack.pop()
        if tag in BLOCK:
            # an open <p> ends where a block starts, even with inline elements left open inside
            for k in range(len(self.stack) - 1, -1, -1):
                if self.stack[k][0] in BLOCK:
                    if self.stack[k][0] == "p" and tag in CLOSES["p"]:
                        del self.stack[k:]
                    break
            self._break()
        noise, inside = (self.stack[-1][1], self.stack[-1][2]) if self.stack else (0, -1)
        a = {k: v or "" for k, v in attrs}
        names = f"{a.get('class', '')} {a.get('id', '')}"
        role = a.get("role", "").lower()
        rank = 3 if tag == "article" or role == "article" else 2 if tag == "main" or role == "main" else 1 if tag in ("div", "section", "td") and ARTICLE.search(names) else 0
        if noise < 2 and tag not in ("html", "body"):
            own_header = tag == "header" and inside >= 0 and self.containers[inside][1] >= 2
            if (tag in SKIP and not own_header) or role in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or (rank < 2 and HARD.search(names)):
                noise = 2
            elif rank >= 2:
                noise = 0
            elif SOFT.search(names) and not own_header:
                noise = 1
        if tag in CONTAINERS and noise < 2:
            parent = self.containers[inside] if inside >= 0 else (-1, 0, 0)
            self.containers.append((inside, rank, parent[2] + 1))
            inside = len(self.containers) - 1
        self.stack.append((tag, noise, inside))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCK:
            self._break()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if self.stack[k][0] in BLOCK and tag not in BLOCK:
                return  # a stray inline end tag closes nothing outside its block

    def handle_data(self, data):
        tag, noise, inside = self.stack[-1] if self.stack else ("", 0, -1)
        if self.fresh or (self.lines and self.lines[-1][2:4] != [inside, noise]):
            if not data.strip() and self.fresh:
                return
            self.lines.append([[], 0, inside, noise, next((t for t, _, _ in reversed(self.stack) if t in BLOCK), "")])
            self.fresh = False
        self.lines[-1][0].append(data)
        self.lines[-1][1] += self.tags
        self.tags = 0


def smooth(ratios: list[float], sigma: float = 1.0, radius: int = 2) -> list[float]:
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    total = sum(kernel)
    n = len(ratios)
    return [sum(k * ratios[min(max(i + d, 0), n - 1)] for k, d in zip(kernel, range(-radius, radius + 1), strict=True)) / total for i in range(n)]


def region(p: Events, lines: list[tuple], picked: list[bool]) -> list[tuple]:
    """The lines that the clusters choose, noise included."""
    # the clustered text inside each container, its nested ones included; a parent comes before its children
    weight = [0] * len(p.containers)
    for hit, (text, _, inside, _, _) in zip(picked, lines, strict=True):
        if hit and inside >= 0:
            weight[inside] += len(text)
    for k in range(len(weight) - 1, -1, -1):
        if p.containers[k][0] >= 0:
            weight[p.containers[k][0]] += weight[k]
    total = sum(len(x[0]) for hit, x in zip(picked, lines, strict=True) if hit)
    ranked = [k for k, w in enumerate(weight) if p.containers[k][1] and 2 * w > total]
    plain = [k for k, w in enumerate(weight) if w >= MOST * total]
    hits = [i for i, hit in enumerate(picked) if hit]
    if not ranked and not plain:
        return lines[hits[0] : hits[-1] + 1]
    best = max(ranked, key=lambda k: (p.containers[k][1], p.containers[k][2])) if ranked else max(plain, key=lambda k: p.containers[k][2])
    within = [False] * len(weight)
    for k, (parent, _, _) in enumerate(p.containers):
        within[k] = k == best or (parent >= 0 and within[parent])
    own = [i for i, x in enumerate(lines) if x[2] >= 0 and within[x[2]]]
    if ranked:
        return [lines[i] for i in own]
    return [lines[i] for i in own if hits[0] <= i <= hits[-1] or lines[i][4] in HEADINGS or lines[i][4] == "p"]


def extract(html: str) -> str:
    p = Events()
    p.feed(html)
    p.close()
    lines = [(SPACES.sub(" ", "".join(parts)).strip(), *rest) for parts, *rest in p.lines]
    lines = [x for x in lines if x[0]]
    if not any(x[3] < 2 for x in lines):
        return ""
    raw = [len(text) / max(tags, 1) * (1 - noise / 2) for text, tags, _, noise, _ in lines]
    ratios = smooth(raw)
    mean = sum(ratios) / len(ratios)
    threshold = min(math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios)), max(r for r, x in zip(ratios, lines, strict=True) if x[3] < 2))
    picked = [r >= threshold and x[3] < 2 for r, x in zip(ratios, lines, strict=True)]
    clustered = {id(x) for x, hit, own in zip(lines, picked, raw, strict=True) if hit and own >= threshold}
    return "\n\n".join(x[0] for x in region(p, lines, picked) if x[3] == 0 or id(x) in clustered)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [extract(h or "") for h in b.column("html").to_pylist()]
        A.give_back()
        yield pa.RecordBatch.from_arrays([b.column("page_id").cast(pa.int64()), b.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def query(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", "html").mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
