"""Main text of web pages by tag-path ratios.

Every text node belongs to a root-to-leaf tag path; a path tells containers (div, section, list and the like) from
their siblings, and leaf elements (paragraphs, items, cells) not.  Text length and punctuation are summed per path and
divided by the path's number of nodes; the product of both ratios is smoothed over the page's node sequence, fused with
the path's own, and paths above a threshold are content.  The article is the container that holds all content paths;
a container inside it with no content path is left out where its text is mostly links or short pieces without
punctuation.  Parts whose element or class says that they are not the article's own text are never looked at.

Defined results: null, empty and tag-only pages give an empty text; broken markup is read leniently (an unclosed
paragraph ends where the next block starts; a tag whose quotes never close ends at the next ``>``); repeated rows each
give their text; other columns are ignored; an empty table gives none.  Time grows with a page's length only.
"""

from __future__ import annotations

import math
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([a-zA-Z][^\s/>]*))")
UNQUOTED = re.compile(r"[^>\"']*")
#: A tag longer than this has a quote that was never meant to open; after so many of them, a page's quotes mean nothing.
LONGEST_TAG, BROKEN_TAGS = 1 << 15, 20
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas audio video select xmp noembed noframes".split())
#: Elements that are never the article's own text.
APART = frozenset("nav footer aside form button menu dialog search label fieldset head map".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of a class, id or role that mark what is not the article's own text.
APART_WORDS = frozenset("ad ads advert advertisement advertising adverts adbox banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright discussion disqus footer masthead menu menubar modal nav navbar navigation newsletter notice notices notification alert outbrain pager pagination popup promo promoted promotion recommended related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toc toolbar widget widgets".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？؟،]")
#: Elements whose paths are told from those of their siblings; of these, the ones that may be left out by their ratios.
LEAVES = frozenset("p li td th tr tbody thead tfoot dt dd option hr summary legend caption title".split()) | HEADINGS
CONTAINERS = BLOCKS - LEAVES
LISTS = frozenset("div section ul ol dir center details hgroup".split())
WINDOW, SHARE, PIECE = 2, 0.25, 25


def _apart(tag: str, attrs: str) -> bool:
    if tag in APART or HIDDEN.search(attrs):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(w in APART_WORDS for m in NAMES.finditer(attrs) for w in re.split(r"[\s_\-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()))


def _tag_end(html: str, at: int) -> int:
    """Position of the ``>`` that ends a tag, quoted ones apart; -1 if there is none within LONGEST_TAG."""
    pos, last = at, min(len(html), at + LONGEST_TAG)
    while pos < last:
        pos = UNQUOTED.match(html, pos).end()
        if pos >= last:
            break
        if html[pos] == ">":
            return pos
        pos = html.find(html[pos], pos + 1, last) + 1
        if not pos:
            break
    return -1


class Page:
    """Text nodes in page order (path, block, raw text), and the paths' elements."""

    def __init__(self, html: str):
        self.parent, self.tag, self.apart, self.heading, self.header, self.link = [-1], [""], [False], [False], [False], [False]
        self.nodes: list[tuple[int, int, str]] = []
        self._known: dict[tuple[int, str], int] = {}
        stack, opened = [0], {}
        block, at, end, broken = 0, 0, len(html), 0

        def shut(i: int) -> None:
            for path in stack[i:]:
                opened[self.tag[path]] -= 1
            del stack[i:]

        while at < end:
            m = START.search(html, at)
            start = m.start() if m else end
            if start > at:
                self.nodes.append((stack[-1], block, html[at:start]))
            if not m:
                break
            if not m[2]:
                mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                at = html.find(mark, m.end()) + len(mark)
                if at < len(mark):
                    at = end
                continue
            close = _tag_end(html, m.end()) if broken < BROKEN_TAGS else -1
            if close < 0:
                broken += 1
                close = html.find(">", m.end())
            if close < 0:  # a tag that never ends is text
                self.nodes.append((stack[-1], block, html[start:]))
                break
            at, tag, attrs = close + 1, m[2].lower(), html[m.end() : close]
            if tag in BLOCKS:
                block += 1
            if tag in VOID:
                if tag in ("br", "wbr"):
                    self.nodes.append((stack[-1], block, " " if tag == "br" else ""))
                continue
            if m[1]:
                if opened.get(tag):
                    for i in range(len(stack) - 1, 0, -1):
                        own = self.tag[stack[i]]
                        if own == tag:
                            shut(i)
                            break
                        if own in ("article", "main", "body", "td", "table") and tag not in BLOCKS:
                            break
                continue
            if tag in RAW:
                if not attrs.endswith("/"):
                    last = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    at = last.end() if last else end
                continue
            if tag in BLOCKS:  # an open paragraph ends here, with what is open inside it; so do list items and cells before their likes
                for i in range(len(stack) - 1, 0, -1):
                    own = self.tag[stack[i]]
                    if own in ("p", *HEADINGS) or own == tag and tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                        shut(i)
                        break
                    if own in BLOCKS:
                        break
            if not attrs.endswith("/"):
                if tag == "header":
                    apart = not (opened.get("article") or opened.get("main"))
                else:
                    apart = _apart(tag, attrs)
                stack.append(self._path(stack[-1], tag, apart))
                opened[tag] = opened.get(tag, 0) + 1

    def _path(self, up: int, tag: str, apart: bool) -> int:
        key = up, tag + "!" if apart else tag
        if tag in CONTAINERS or key not in self._known:
            self._known[key] = len(self.parent)
            self.parent.append(up)
            self.tag.append(tag)
            for own, here in ((self.apart, apart), (self.heading, tag in HEADINGS), (self.header, tag == "header"), (self.link, tag == "a")):
                own.append(own[up] or here)
        return self._known[key]


def _content(page: Page, seen: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each path's fused ratio is above the threshold; seen: (path, length, punctuation) of the nodes with text.

    Text in links counts for nothing, and headings don't make what is around them content.
    """
    sums = [[0, 0, 0] for _ in page.parent]
    for p, n, marks in seen:
        sums[p][0] += 0 if page.link[p] else n
        sums[p][1] += 0 if page.link[p] else marks
        sums[p][2] += 1
    ratio = [(n / k) * ((marks + 1) / k) if k else 0.0 for n, marks, k in sums]
    total = [0.0]
    for p, _, _ in seen:
        total.append(total[-1] + ratio[p])
    smooth = [0.0] * len(sums)
    for i, (p, _, _) in enumerate(seen):
        lo, hi = max(0, i - WINDOW), min(len(seen), i + WINDOW + 1)
        smooth[p] = max(smooth[p], (total[hi] - total[lo]) / (hi - lo))
    fused = [math.sqrt(max(0.0, r * s)) for r, s in zip(ratio, smooth, strict=True)]
    least = SHARE * sum(f * s[0] for f, s in zip(fused, sums, strict=True)) / max(1, sum(s[0] for s in sums))
    return [s[0] > 0 and f >= least and not page.heading[p] for p, (f, s) in enumerate(zip(fused, sums, strict=True))]


def extract(html: str | None) -> str:
    """Blocks of the main text joined by newlines."""
    page = Page(html or "")
    own = [(p, block, unescape(raw)) for p, block, raw in page.nodes if not page.apart[p] and (page.heading[p] or not page.header[p])]
    seen = [(p, n, len(PUNCTUATION.findall(t))) for p, _, t in own if (n := len(" ".join(t.split())))]
    if not seen:
        return ""
    content = _content(page, seen)
    # The article: the deepest container of all content paths; inside an article or main element, all of that.
    held = [int(c) for c in content]
    for p in range(len(held) - 1, 0, -1):
        held[page.parent[p]] += held[p]
    root = max((p for p, k in enumerate(held) if k == held[0]), default=0) if held[0] else 0
    # Of a page of links and headings, all.
    while root > 0 and page.tag[root] not in CONTAINERS:
        root = page.parent[root]
    up = root
    while up > 0:
        root = up if page.tag[up] in ("article", "main") else root
        up = page.parent[up]
    # Per container: length, length in links, punctuation, nodes, content paths and headings below it.
    below = [[0, 0, 0, 0, 0, 0] for _ in content]
    for p, n, marks in seen:
        for k, x in enumerate((n, n * page.link[p], marks, 1, content[p], page.heading[p])):
            below[p][k] += x
    for p in range(len(below) - 1, 0, -1):
        for k, x in enumerate(below[p]):
            below[page.parent[p]][k] += x
    kept = [False] * len(content)
    for p, (n, links, marks, k, good, heads) in enumerate(below):
        if p == root:
            kept[p] = True
        elif p and kept[page.parent[p]]:
            stray = not good and n and page.tag[p] in LISTS and (2 * links >= n or not heads and not marks and n < PIECE * k)
            kept[p] = not stray
    parts: dict[int, list[str]] = {}
    for p, block, t in own:
        if kept[p]:
            parts.setdefault(block, []).append(t)
    lines = (" ".join("".join(ts).split()) for ts in parts.values())
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame, *, keep: list[str], html_col: str = "html") -> DataFrame:
    """``keep`` columns with text and n_chars (code points) for every row."""
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("html__"))
    schema = rows.drop("html__").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for b in batches:
            texts = [extract(h.as_py()) for h in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    return rows.mapInArrow(run, schema)
