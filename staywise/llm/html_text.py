"""Main text of web pages by tag-path ratios.

Every block of text belongs to its root-to-leaf tag path, which ends with its last
block-level element: inline elements follow the block they stand in. Per path the text
length, the punctuation and the number of blocks are summed over the page; text per
block and punctuation per block are fused into the path's ratio. Ratios are smoothed
along the page (neighbouring nodes share part of theirs) and up the tree (a path
shares the ratio of the container it lies in), because headings and short
paragraphs belong to the text around them. Paths above a threshold relative to
the best path are content; all their blocks are returned in page order. So is every
other text inside a marked article or, on a page that marks none, in the container
that holds most of the content (in the body only between content), unless the list,
table or block it lies in is mostly links.

What a page marks as something else is no candidate: elements of navigation,
headers and footers of the page, asides, forms, scripts and styles, hidden
elements, and elements whose class, id or role names an advert, menu, notice,
comment section and the like by a whole word of that name. A form, or an element so
named, is a candidate nevertheless where it holds most of the page's text, or the
only marked article; comment sections and the like never are. A page that marks its article (``article``,
``main`` or the matching role or itemprop) has its candidates inside it; of several
articles those count that stand beside the longest one, under the same parent, so
that reader comments marked as articles elsewhere do not.

Blocks: block-level elements bound a block, inline elements and ``br`` do not.
White space inside a block becomes one space; blocks are joined by ``\\n\\n``.
Character references are decoded. NULL, empty or text-less pages give an empty
text; broken markup is read as far as it goes, to the end of the page. Every row
stands for itself, so repeated rows do not matter; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import ship

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "script style noscript template head title svg math canvas iframe object select textarea button option "
    "nav footer aside form menu dialog audio video map datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
ENDED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
LIST_BOUNDS = frozenset(["ul", "ol", "menu", "table", "dl", "tr"])
NOISE = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|primary|secondary|top|bottom|global|post|entry|article)[_-])?"
    r"(?:ads?|advert\w*|adsense|adslot|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|side-bar|aside|footer|masthead|site-header|page-header|topbar|cookies?|consent|notice|alert|popup|modal|overlay|"
    r"comments?|comment-\w+|disqus|replies|respond|discussion|social|share|sharing|follow|related|recommend\w*|"
    r"read-more|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|widget|skip-link|screen-reader-text|"
    r"hidden|copyright|disclaimer|legal)"
    r"(?:[_-](?:area|section|box|bar|block|wrap|wrapper|container|list|links?|posts?|items?|articles|stories|banner|notice|menu|nav|form|"
    r"buttons?|icons?|inner|widgets?|thread|media|\d+))*(?=$|\s)",
    re.IGNORECASE,
)
NEVER = re.compile(
    r"(?:^|[\s_-])(?:comments?|comment-\w+|disqus|replies|respond|discussion|related|recommend\w*|cookies?|consent|popup|hidden)(?=$|[\s_\d-])",
    re.IGNORECASE,
)
MOST = 0.5  # of the page's text, for a form or a named element to be a wrapper
CONTAINER = 0.8  # of the content's text, for the container that holds it
LINKS = 0.5  # of a list's, table's or block's text, for it to be a menu
LEAVES = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figcaption tr ul ol dl".split())
GROUPS = frozenset("ul ol dl menu table div section p h1 h2 h3 h4 h5 h6 blockquote pre figure".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar alertdialog note".split())
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…]")
SMOOTH = 0.25  # share of each neighbour's ratio
# the container's share of a path's ratio, and the least ratio, as a part of the best path's
OPEN, MARKED = (0.2, 0.35), (0.5, 0.1)  # on an unmarked page; inside a marked article


class _Page(HTMLParser):
    """Text nodes of a page with their tag path, block number and whether they can be content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        # tag, skipped, in the article, label, number, numbers of the forms and named elements around
        self.stack: list[tuple[str, bool, bool, str, int, tuple[int, ...]]] = []
        self.nodes: list[tuple[tuple[str, ...], int, bool, bool, str, tuple[int, ...], tuple[int, ...]]] = []
        self.block = 0
        self.tags: list[str] = []
        self.never: set[int] = set()  # numbers of those that are never candidates
        self.articles: set[int] = set()  # numbers of the elements that are articles

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            if tag == "hr":
                self._close_paragraph()
                self.block += 1
            return
        if tag in PARAGRAPH_ENDS:
            self._close_paragraph()
        ends = ENDED_BY.get(tag)
        if ends:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ends:
                    del self.stack[i:]
                    break
                if self.stack[i][0] in LIST_BOUNDS:
                    break
        skipped = self.stack[-1][1] if self.stack else False
        inside = self.stack[-1][2] if self.stack else False
        label = tag
        given = {k: v or "" for k, v in attrs}
        names = f"{given.get('class', '')} {given.get('id', '')}".strip()
        noise = tag not in ("html", "body", "main") and bool(NOISE.search(names))
        doubtful = self.stack[-1][5] if self.stack else ()
        number = len(self.tags)
        self.tags.append(tag)
        marked = tag in ("article", "main") or given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody"
        if tag == "article" or given.get("role") == "article":
            self.articles.add(number)
        if marked and not noise:
            inside = True
        elif not skipped:
            skipped = (
                (tag in SKIPPED and tag != "form")
                or (tag == "header" and not inside)
                or given.get("role") in NOISE_ROLES
                or "hidden" in given
                or given.get("aria-hidden") == "true"
                or "display:none" in given.get("style", "").replace(" ", "").lower()
            )
        if not (marked and not noise) and (noise or tag == "form" or given.get("role") == "form"):
            doubtful += (number,)
            if noise and NEVER.search(names):
                self.never.add(number)
        if names:
            label = f"{tag}.{names}"
        if tag not in INLINE:
            self.block += 1
        self.stack.append((tag, skipped, inside, label, number, doubtful))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_data(" ")
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if any(open_tag not in INLINE for open_tag, *_ in self.stack[i:]):
                    self.block += 1
                del self.stack[i:]
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return  # a stray end of an inline element does not close a block

    def _close_paragraph(self) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == "p":
                del self.stack[i:]
                self.block += 1
                return
            if self.stack[i][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        skipped, inside, doubtful = (self.stack[-1][1], self.stack[-1][2], self.stack[-1][5]) if self.stack else (False, False, ())
        self.nodes.append((tuple(e[3] for e in self.stack), self.block, skipped, inside, data, doubtful, tuple(e[4] for e in self.stack)))

    def usable(self) -> list[tuple]:
        """The nodes that can be content."""
        nodes = [n for n in self.nodes if not n[2]]
        held, article, total, free = defaultdict(int), set(), 0, False
        for _, _, _, inside, text, doubtful, _ in nodes:
            size = len(text.strip())
            total += size
            for number in doubtful:
                held[number] += size
            if inside and size:
                free = free or not doubtful
                article.update(doubtful)
        wrapper = {n for n, size in held.items() if n not in self.never and (size > MOST * total or (not free and n in article))}
        return self._beside_longest([n for n in nodes if wrapper.issuperset(n[5])])

    def _beside_longest(self, nodes: list[tuple]) -> list[tuple]:
        """The nodes without those of articles that stand elsewhere than the longest one."""
        tops = [next((at for at, number in enumerate(n[6]) if number in self.articles), None) for n in nodes]
        held, parent = defaultdict(int), {}
        for n, at in zip(nodes, tops):
            if at is not None:
                held[n[6][at]] += len(n[4].strip())
                parent[n[6][at]] = n[6][at - 1] if at else -1
        if len(set(parent.values())) < 2:
            return nodes
        where = parent[max(held, key=held.get)]
        return [n for n, at in zip(nodes, tops) if at is None or parent[n[6][at]] == where]


class _Block:
    """One block: its path and element numbers up to the last block-level one, its text, and how much of it is links."""

    def __init__(self, tags: list[str], nodes: list[tuple]):
        first = nodes[0]
        depth = max((at + 1 for at, number in enumerate(first[6]) if tags[number] not in INLINE), default=0)
        self.path, self.numbers = first[0][:depth], first[6][:depth]
        self.text = " ".join("".join(n[4] for n in nodes).split())
        self.size = sum(len(n[4].strip()) for n in nodes)
        self.links = sum(len(n[4].strip()) for n in nodes if any(tags[number] == "a" for number in n[6]))


def _ratios(nodes: list[tuple[tuple[str, ...], str]], upward: float) -> dict[tuple[str, ...], float]:
    """Fused, smoothed ratio of each path."""
    length, marks, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, text in nodes:
        length[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    own = {p: math.sqrt(length[p] / count[p] * (1 + marks[p]) / count[p]) for p in count}
    # along the page
    line = [own[path] for path, _ in nodes]
    near = defaultdict(list)
    for i, (path, _) in enumerate(nodes):
        before, after = line[max(i - 1, 0)], line[min(i + 1, len(line) - 1)]
        near[path].append((1 - 2 * SMOOTH) * line[i] + SMOOTH * (before + after))
    # up the tree: the container's ratio over all text below it
    below_length, below_marks, below_count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path in count:
        for depth in range(1, len(path)):
            up = path[:depth]
            below_length[up] += length[path]
            below_marks[up] += marks[path]
            below_count[up] += count[path]
    fused = {}
    for path, values in near.items():
        around = 0.0
        for depth in range(len(path) - 1, 0, -1):
            up = path[:depth]
            if below_count[up] > count[path]:  # the nearest container that holds more than this path
                around = math.sqrt(below_length[up] / below_count[up] * (1 + below_marks[up]) / below_count[up])
                break
        fused[path] = (1 - upward) * sum(values) / len(values) + upward * around
    return fused


def _menus(tags: list[str], blocks: list[_Block], container: int | None = None) -> list[bool]:
    """Per block whether the list, table or block it lies in, below the container, is mostly links."""

    def group(at: int, numbers: tuple[int, ...]) -> int:
        below = numbers[numbers.index(container) + 1 :] if container in numbers else numbers
        return next((n for n in reversed(below) if tags[n] in GROUPS), -1 - at)

    groups = [group(at, b.numbers) for at, b in enumerate(blocks)]
    size, links = defaultdict(int), defaultdict(int)
    for at, b in zip(groups, blocks):
        size[at] += b.size
        links[at] += b.links
    return [links[at] > LINKS * size[at] for at in groups]


def _with_container(tags: list[str], blocks: list[_Block], content: list[bool]) -> list[bool]:
    """The content and what else its container holds, without lists, tables and blocks of mostly links."""
    if all(content):
        return content
    chosen = [i for i, wanted in enumerate(content) if wanted]
    held, depth = defaultdict(int), {}
    for i in chosen:
        for level, number in enumerate(blocks[i].numbers):
            if tags[number] not in LEAVES:
                held[number] += blocks[i].size
                depth[number] = level
    total = sum(blocks[i].size for i in chosen)
    container = max((n for n, size in held.items() if size >= CONTAINER * total), key=depth.get, default=None)
    within = range(len(blocks))
    if container is None or tags[container] in ("html", "body"):
        within = range(chosen[0], chosen[-1])
    out, menus = list(content), _menus(tags, blocks, container)
    for i in within:
        if container is None or container in blocks[i].numbers:
            out[i] = out[i] or not menus[i]
    return out


def main_text(html: str) -> str:
    page = _Page()
    page.feed(html)
    page.close()
    usable = page.usable()
    marked = any(n[3] and n[4].strip() for n in usable)
    runs = groupby((n for n in usable if n[3] or not marked), key=lambda n: n[1])
    blocks = [b for b in (_Block(page.tags, list(nodes)) for _, nodes in runs) if b.text]
    if not blocks:
        return ""
    upward, least = MARKED if marked else OPEN
    fused = _ratios([(b.path, b.text) for b in blocks], upward)
    least *= max(fused.values())
    content = [fused[b.path] >= least for b in blocks]
    if marked:
        content = [wanted or not menu for wanted, menu in zip(content, _menus(page.tags, blocks))]
    else:
        content = _with_container(page.tags, blocks, content)
    return "\n\n".join(b.text for b, wanted in zip(blocks, content) if wanted)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py() or "") for h in batch.column("h")]
        yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("u"), pa.array(texts, pa.string())], names=["k", "u", "text"])


def extract_text(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: key, url, text, n_chars."""
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in (("k", key), ("u", url)))
    rows = df.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).cast("string").alias("h"))
    return rows.mapInArrow(_extract, f"{kinds}, text string").select(
        F.col("k").alias(key), F.col("u").alias(url), "text", F.char_length("text").cast("long").alias("n_chars")
    )


ship(__name__)
