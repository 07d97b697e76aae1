"""Main text of web pages by tree scoring.

A tolerant scanner builds a light tree (implied end tags, unclosed elements,
raw-text elements). Elements that are never the article by tag, role or style are
left out. Elements named like a side matter (whole class or id words first,
parts of words less surely) are left out too, unless they hold most of the page's
paragraphs; the same holds for forms, of which the controls always go.

Every paragraph gives points (one, one per comma, one per hundred characters up to
three) to its container, half as many to the next one out, and so on; a container's
points are discounted by the share of its text that stands in links. The best
container is widened to an enclosing article or main element. Then its siblings, and
those of the containers around it, join if they have enough points or are proper
paragraphs, headings of what is kept, or lists, tables and the like with few links.

All sums go from children to parents in one pass, so time grows with the page alone.

Output text: character references decoded, white space inside a block as one space,
blocks in page order joined by one space.

Defined cases: null and empty html, and pages without text outside left-out
subtrees, give an empty text; repeated rows give repeated results; an empty
table gives no rows; extra columns are ignored; a null url stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# HTML element names by behaviour.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "body", "html", "head"}
LEFT_OUT = frozenset("nav footer aside button select option input textarea label legend script style noscript iframe template svg math head title dialog menu object embed applet audio video canvas datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE_OF_TEXT = frozenset("ul ol dl table pre blockquote figure".split())
REGIONS = frozenset("article main".split())
OUTERMOST = frozenset("#root html body".split())
LEFT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar note status".split())
# Words of class and id names that mark what is not the article, and what is.
SIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promotion promoted comment comments commentlist disqus discussion replies respond cookie cookies cookiebar consent gdpr notice notices sidebar newsletter subscribe subscription paywall popup modal overlay breadcrumb breadcrumbs nav navbar navigation navi menu menus submenu footer foot footnav masthead topbar toolbar share sharing social related recommended recommendations login signin signup register search searchbox skip pagination pager widget widgets tagcloud disclaimer alert banner".split()
)
SIDE_PAIRS = frozenset("side-bar site-header page-header site-footer page-footer top-bar tag-cloud skip-link".split())
UNLIKELY_WORDS = frozenset("header head meta byline tags tools outbrain taboola extra shoutbox legends rss utility".split())
LIKELY_WORDS = frozenset("article articles body content contents main entry story post text hentry blog page wrapper container layout site".split())
NEUTRAL_WORDS = frozenset("list box area block bar link links item items container inner count title panel unit slot bottom section group".split())
STATES = frozenset("has with without no not is js open closed enabled disabled free allowed visible active on off left right top none".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
BONUS = {"article": 25.0, "main": 15.0, "div": 2.0, "section": 3.0, "pre": 2.0, "td": 1.0, "blockquote": 1.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0, "address": -3.0}
LEAST_PARAGRAPH, PROPER_PARAGRAPH = 25, 80
#: Strength of a name: none, by a part of a word, by a whole word.
PLAIN, PARTLY, WHOLLY = 0, 1, 2


@cache
def _named(name: str) -> tuple[int, bool]:
    """(how surely the class and id words mark side matter, whether one of them is likely the article's)."""
    strength, likely, unlikely = PLAIN, False, False
    for word in name.lower().split():
        parts = [p for p in re.split(r"[-_]+", word) if p]
        sides = [p in SIDE_WORDS for p in parts]
        pair = any(f"{a}-{b}" in SIDE_PAIRS for a, b in zip(parts, parts[1:], strict=False))
        if pair or (any(sides) and all(s or p in NEUTRAL_WORDS or p.isdigit() for s, p in zip(sides, parts, strict=True))):
            strength = WHOLLY
        elif any(sides):
            strength = max(strength, PARTLY)
            state = parts[0] in STATES or parts[-1] in STATES
            likely = likely or (state and any(p in LIKELY_WORDS for p in parts))
        elif parts and parts[-1] in UNLIKELY_WORDS:
            unlikely = True
        elif any(p in LIKELY_WORDS for p in parts):
            likely = True
    if strength == PLAIN and unlikely and not likely:
        strength = PARTLY
    if strength == PARTLY and likely:
        strength = PLAIN
    return strength, likely


class _Tree:
    """Elements as parallel lists; blocks of text with the element they stand in."""

    def __init__(self) -> None:
        self.tag, self.parent, self.block, self.side, self.likely = ["#root"], [-1], [0], [PLAIN], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.stack = [0]
        self.open_at: dict[str, list[int]] = {}  # depths of the open elements, by tag
        self.block_depths: list[int] = []
        self.out = 0  # depth of the outermost left-out element, 0: none
        self.pieces: list[str] = []
        self.linked = 0

    def flush(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append((self.block[self.stack[-1]], text, min(self.linked, len(text))))
            self.pieces, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw and not self.out:
            text = unescape(raw) if "&" in raw else raw
            self.pieces.append(text)
            if self.open_at.get("a"):
                self.linked += len(text.strip())

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag = self.tag[self.stack[-1]]
            if tag in BLOCK:
                self.flush()
                self.block_depths.pop()
            self.open_at[tag].pop()
            self.stack.pop()
            if self.out and len(self.stack) < self.out:
                self.out = 0
                self.pieces, self.linked = [], 0

    def deepest(self, names) -> int:
        return max((at[-1] for t in names if (at := self.open_at.get(t))), default=0)

    def find(self, names, stop=()) -> int:
        """Depth of the innermost open element of these names, 0 if there is none inside the innermost ``stop``."""
        depth = self.deepest(names)
        return depth if depth and (not stop or depth > self.deepest(stop)) else 0

    def open(self, tag: str, attrs: str) -> None:
        if tag in CLOSES_P and self.open_at.get("p") and (d := self.find(("p",), ("table", "td", "th", "button", "object"))):
            self.pop_to(d)
        if tag in HEADINGS and self.tag[self.stack[-1]] in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        for group, stop in _IMPLIED.get(tag, ()):
            if d := self.find(group, stop):
                self.pop_to(d)
        if tag == "a" and (at := self.open_at.get("a")) and at[-1] > (self.block_depths[-1] if self.block_depths else 0):
            self.pop_to(at[-1])
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.text(" ")
        if tag in VOID:
            return
        out = tag in LEFT_OUT or (tag == "header" and not any(self.open_at.get(t) for t in REGIONS))
        side, likely = PLAIN, False
        if attrs and not self.out and tag not in ("html", "body"):
            found = {k.lower(): a or b or c or "" for k, a, b, c in _ATTR.findall(attrs)}
            side, likely = _named(f"{found.get('class', '')} {found.get('id', '')}".strip())
            if tag in REGIONS or tag in HEADINGS and side == PARTLY:
                side = PLAIN
            if tag not in REGIONS and tag != "form":
                out = out or found.get("role", "").lower() in LEFT_ROLES
            out = out or "hidden" in found or found.get("aria-hidden") == "true" or bool(HIDDEN.search(found.get("style", "")))
            out = out or (side > PLAIN and tag not in BLOCK)  # inside a line nothing can hold most of the page
        if tag == "form":
            side = max(side, PARTLY)
        i = len(self.tag)
        self.tag.append(tag)
        self.parent.append(self.stack[-1])
        self.block.append(i if tag in BLOCK else self.block[self.stack[-1]])
        self.side.append(side)
        self.likely.append(likely)
        self.open_at.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCK:
            self.block_depths.append(len(self.stack))
        self.stack.append(i)
        if out and not self.out:
            self.out = len(self.stack)

    def close(self, tag: str) -> None:
        if tag == "br":
            self.text(" ")
            return
        d = self.find((tag,))
        if d and (tag in BLOCK or d > (self.block_depths[-1] if self.block_depths else 0)):
            self.pop_to(d)
        elif tag in BLOCK:
            self.flush()


_TABLE = ("table",)
_IMPLIED = {
    "li": [(("li",), ("ul", "ol", "menu", "dir"))],
    "dd": [(("dd", "dt"), ("dl",))],
    "dt": [(("dd", "dt"), ("dl",))],
    "tr": [(("tr",), _TABLE)],
    "td": [(("td", "th"), ("tr", "table"))],
    "th": [(("td", "th"), ("tr", "table"))],
    "tbody": [(("tbody", "thead", "tfoot"), _TABLE)],
    "thead": [(("tbody", "thead", "tfoot"), _TABLE)],
    "tfoot": [(("tbody", "thead", "tfoot"), _TABLE)],
    "option": [(("option",), ("select",))],
    "body": [(("head",), ())],
}


@cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)


def _grow(html: str) -> _Tree:
    tree, at, n = _Tree(), 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            rest = html[at:]
            cut = re.search(r"</?[a-zA-Z!?]", rest)  # an unfinished tag at the end is no text
            tree.text(rest[: cut.start()] if cut else rest)
            break
        tree.text(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            tree.close(tag)
            continue
        attrs = m[3] or m[6] or ""
        tree.open(tag, attrs)
        if tag in RAW and not attrs.endswith("/"):
            end = _end_of(tag).search(html, at)
            at = end.end() if end else n
            tree.pop_to(len(tree.stack) - 1)
        elif attrs.endswith("/") and tag not in BLOCK and tag not in VOID:
            tree.pop_to(len(tree.stack) - 1)
    tree.pop_to(1)
    tree.flush()
    return tree


def _summed(parent: list[int], own: list, share: float = 1) -> list:
    """Every element's own value plus ``share`` of its children's sums; parents stand before their children."""
    out = list(own)
    for i in range(len(out) - 1, 0, -1):
        out[parent[i]] += out[i] * share
    return out


def _proper(text: str, linked: int) -> bool:
    """Whether a line reads like a paragraph."""
    return (len(text) > PROPER_PARAGRAPH and linked < 0.25 * len(text)) or (not linked and text[-1:] in ".!?…。！？")


def _left_out(tree: _Tree) -> list[bool]:
    """Elements outside the page's text by their names, with all that they hold."""
    n, parent = len(tree.tag), tree.parent
    prose, heads = [0] * n, [0] * n
    for at, text, linked in tree.blocks:
        if len(text) >= LEAST_PARAGRAPH and linked < 0.5 * len(text) and tree.tag[at] not in HEADINGS:
            prose[at] += len(text)
        if tree.tag[at] == "h1":
            heads[at] += 1
    for i, tag in enumerate(tree.tag):
        if tag == "main":
            heads[i] += 1
    prose, heads = _summed(parent, prose), _summed(parent, heads)
    total = prose[0]
    out = [False] * n
    for i in range(1, n):
        out[i] = out[parent[i]]
        if not out[i] and tree.side[i]:
            most = 2 * prose[i] > total and (tree.side[i] == PARTLY or heads[i] > 0)
            out[i] = not most
    return out


def main_text(html: str | None) -> str:
    """The text of the page's article."""
    if not html:
        return ""
    tree = _grow(html.replace("\0", ""))
    gone = _left_out(tree)
    blocks = [b for b in tree.blocks if not gone[b[0]]]
    if not blocks:
        return ""
    parent, tag, n = tree.parent, tree.tag, len(tree.tag)
    chars, links, good, points = [0] * n, [0] * n, [0] * n, [0.0] * n
    for at, text, linked in blocks:
        chars[at] += len(text)
        links[at] += linked
        if tag[at] not in HEADINGS and tag[at] not in ("td", "th", "li") and _proper(text, linked):
            good[at] += len(text)
        if len(text) >= LEAST_PARAGRAPH and tag[at] not in HEADINGS:
            own = 1.0 + text.count(",") + text.count("，") + text.count("、") + min(len(text) // 100, 3)
            points[at if tag[at] in ("div", "section", "article", "main", "body", "td", "#root") else parent[at]] += own
    chars, links, good, points = _summed(parent, chars), _summed(parent, links), _summed(parent, good), _summed(parent, points, 0.5)
    for i in range(n):
        if points[i]:
            points[i] = (points[i] + BONUS.get(tag[i], 0.0) + 5.0 * tree.likely[i]) * (1.0 - links[i] / max(chars[i], 1))
    best = max(range(n), key=lambda i: (points[i], -i))
    if points[best] <= 0:
        best = 0
    i = best
    while i > 0:
        if tag[i] in REGIONS:
            best = i
            break
        i = parent[i]

    # What joins: level after level outwards, the children of one container at a time.
    children: dict[int, list[int]] = {}
    chain, i = [], best
    while i > 0:
        chain.append(i)
        children[parent[i]] = []
        i = parent[i]
    for i in range(1, n):
        if parent[i] in children and chars[i] and not gone[i]:
            children[parent[i]].append(i)
    keep = {best}
    floor = max(10.0, 0.2 * points[best])
    for inner in chain:
        outer = parent[inner]
        strict = tag[outer] in OUTERMOST or tag[inner] in REGIONS
        before, heading = True, []
        for i in children[outer]:
            if i == inner:
                before = False
                keep.update(heading)
                heading = []
                continue
            dense = links[i] >= 0.25 * chars[i]
            if tag[i] in HEADINGS:
                if not dense:
                    heading.append(i)
                continue
            joins = points[i] >= floor
            if tag[i] == "p":
                joins = joins or (good[i] > 0)
            elif tag[i] in ASIDE_OF_TEXT:
                joins = joins or (not strict and not dense and chars[i] >= LEAST_PARAGRAPH)
            elif tag[i] == "header" or (before and chars[i] and not strict and _only_heading(tree, i, n)):
                joins = joins or not dense
            else:
                joins = joins or (not dense and good[i] >= (PROPER_PARAGRAPH if not strict or tree.likely[i] else max(PROPER_PARAGRAPH, good[inner] // 5)))
            if joins:
                keep.update(heading)
                keep.add(i)
            heading = [] if not before else heading
    inside = [False] * n
    for i in range(n):
        inside[i] = not gone[i] and (i in keep or (i > 0 and inside[parent[i]]))
    if best == 0:
        inside = [not g for g in gone]
    return " ".join(text for at, text, _ in blocks if inside[at])


def _only_heading(tree: _Tree, at: int, n: int) -> bool:
    """Whether an element holds a heading of the first or second order and no other block of text."""
    first = None
    for i in range(at + 1, n):
        if tree.parent[i] < at:
            break
        if tree.tag[i] in ("h1", "h2"):
            first = i
        elif tree.tag[i] in BLOCK and tree.tag[i] not in ("div", "hgroup", "section", "header"):
            return False
    return first is not None


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")
