"""Main text of HTML pages by minimum cut.

A page is cut into blocks of text.  A classifier on a block's place and text gives the odds
that it is content; they are the block's capacities to the two terminals.  Blocks that
follow each other, and blocks in the same element, are joined by edges whose capacity falls
with their distance in the document tree.  The minimum cut labels all blocks at once: the sum
of what is paid against the classifier and of the edges between content and
boilerplate is as small as possible.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import ship, small_batches

#: Capacity between neighbours in the same element, and its factor for each step of tree distance.
NEAR, FADE = 0.8, 0.6
#: Capacity between a block and the next one of the same element further on.
SAME = 0.3

#: Elements without an end tag, without text of the page, and within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
#: Which open elements a start tag closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
SCOPES = frozenset("html body table ul ol dl select article aside section main nav header footer form div td th".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)
#: The classifier: what an element, a word in its class, id or role, and the text add to the odds.
TAG_ODDS = {
    "article": 4.0, "main": 3.0, "p": 1.5, "blockquote": 1.0, "pre": 1.0, "h1": 1.0, "h2": 0.5, "h3": 0.5,
    "li": -0.5, "nav": -7.0, "menu": -7.0, "footer": -7.0, "header": -4.0, "aside": -7.0, "form": -7.0, "button": -7.0,
    "select": -7.0, "dialog": -7.0, "head": -20.0, "noscript": -9.0, "template": -20.0, "svg": -20.0, "object": -9.0,
    "label": -3.0, "legend": -3.0, "figcaption": -0.5,
}
CONTENT_NAMES = frozenset("article articlebody post entry story content main maintext body text".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising adsense banner banners sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices alert popup modal overlay sidebar side menu menus nav navbar navigation breadcrumb "
    "breadcrumbs footer foot header masthead share sharing social related recommended recommendations comment comments "
    "reply replies respond discussion disqus subscribe subscription newsletter login signin signup register search "
    "pagination pager toolbar widget widgets copyright legal tags skip complementary contentinfo form teaser outbrain "
    "taboola reactions".split()
)
CONTENT_NAME_ODDS, BOILERPLATE_NAME_ODDS, HIDDEN_ODDS = 2.5, -7.5, -20.0
#: Text that could be content, outside an element in doubt, that confirms the doubt: more characters than a heading has.
ELSEWHERE = 120
NOTICE = "all rights reserved"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""(?i)(?:^|[\s"'])(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_HIDDEN = re.compile(r"""(?i)(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    __slots__ = ("text", "odds", "path", "linked")

    def __init__(self, text: str, odds: float, path: tuple[int, ...], linked: int):
        self.text, self.odds, self.path, self.linked = text, odds, path, linked


def element_odds(tag: str, attributes: str) -> tuple[float, float]:
    """What an element adds to the odds of all blocks in it: for sure, and in doubt.

    A class, id or role made of boilerplate words alone is sure (``cookie-notice``); one with other words
    beside (``has-sidebar``) may name an element that only has such a thing in it.  A form may be around a whole page.
    """
    sure, doubt = TAG_ODDS.get(tag, 0.0), 0.0
    if tag == "form":
        sure, doubt = 0.0, sure
    if attributes:
        if _HIDDEN.search(attributes):
            sure += HIDDEN_ODDS
        tokens = [
            set(_PARTS.findall(_CAMEL.sub(" ", token).lower()))
            for found in _NAMES.findall(attributes)
            for token in "".join(found).split()
        ]
        if tag not in ("html", "body") and any(names & BOILERPLATE_NAMES for names in tokens):
            if tag in INLINE or any(names and names <= BOILERPLATE_NAMES for names in tokens):
                sure += BOILERPLATE_NAME_ODDS
            else:
                doubt += BOILERPLATE_NAME_ODDS
        elif any(names & CONTENT_NAMES for names in tokens):
            sure += CONTENT_NAME_ODDS
    return sure, doubt


def _text_odds(text: str, linked: int) -> float:
    """What the text of a block adds."""
    words = text.count(" ") + 1
    odds = -1.0 + 0.05 * min(words, 40)
    if linked:
        odds -= 4.0 * linked / len(text)
    if text[-1] in ".!?…:;\"”»":
        odds += 0.5
    if text[0] in "©":
        odds -= 3.0
    elif NOTICE in text.lower():  # the less of the block it is, the less it says
        odds -= 3.0 * min(1.0, 10 * len(NOTICE) / len(text))
    return odds


def _settle(found: list[Block], doubts: list[list]) -> None:
    """Add to the odds what elements in doubt add, unless nearly all that could be content is inside.

    ``doubts`` holds, from the outermost on, the first block of an element, the one after its last, and its odds.
    An element whose doubt is confirmed settles all inside it.
    """
    open_doubts = [0] * len(found)
    for first, last, _ in doubts:
        for at in range(first, last):
            open_doubts[at] += 1
    weights = [len(block.text) if block.odds > 0 else 0 for block in found]
    free = sum(w for w, n in zip(weights, open_doubts) if n == 0)
    settled = 0
    for first, last, odds in doubts:
        inside = range(first, last)
        if first < settled:
            confirmed = True
        else:
            confirmed = free - sum(weights[at] for at in inside if open_doubts[at] == 0) >= ELSEWHERE
        for at in inside:
            if confirmed:
                found[at].odds += odds
            else:
                open_doubts[at] -= 1
                free += weights[at] if open_doubts[at] == 0 else 0
        if confirmed:
            settled = max(settled, last)


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; a tag that isn't closed reaches as far as its parent."""
    found: list[Block] = []
    parts: list[str] = []
    doubts: list[list] = []
    # element, odds so far, number of the element, its doubt
    stack: list[tuple[str, float, int, list | None]] = [("", 0.0, 0, None)]
    count = linked = in_links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                odds = stack[-1][1] + _text_odds(text, min(linked, len(text)))
                found.append(Block(text, odds, tuple(x[2] for x in stack if x[0] not in INLINE), linked))
            parts.clear()
        linked = 0

    def pop(size: int) -> None:
        nonlocal in_links
        while len(stack) > size:
            tag, _, _, doubt = stack.pop()
            if doubt is not None:
                doubt[1] = len(found)
            if tag == "a":
                in_links -= 1

    def text_until(end: int) -> None:
        nonlocal linked
        if end > at:
            piece = page[at:end]
            parts.append(piece)
            if in_links:
                linked += len(piece.strip())

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        text_until(token.start() if token else size)
        if token is None:
            break
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            continue
        tag, attributes = name.lower(), token[3] or token[6] or ""
        if token[1] or token[4]:  # an end tag
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth][0] == tag:
                    if tag not in INLINE:
                        flush()
                    pop(depth)
                    break
                if tag in INLINE and stack[depth][0] not in INLINE:
                    break
            continue
        if tag not in INLINE:
            flush()
        if tag in ENDS_P:
            _close(stack, {"p"}, pop)
        elif tag in CLOSES:
            _close(stack, CLOSES[tag], pop)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.IGNORECASE).search(page, at)
            if end is None:
                at = size
            else:
                close = page.find(">", end.start())
                at = size if close < 0 else close + 1
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
            count += 1
            in_links += tag == "a"
            sure, odds = element_odds(tag, attributes)
            doubt = [len(found), 0, odds] if odds else None
            if doubt:
                doubts.append(doubt)
            stack.append((tag, stack[-1][1] + sure, count, doubt))
    flush()
    pop(1)
    _settle(found, doubts)
    return found


def _close(stack: list[tuple], tags: set[str], pop) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth][0] in tags:
            pop(depth)
            if tags == {"p"}:
                return
        elif stack[depth][0] in SCOPES and stack[depth][0] not in tags:
            return


def edges_of(found: Sequence[Block]) -> list[tuple[int, int, float]]:
    """Capacities between neighbours, and between a block and the next one in the same element."""
    edges = []
    last: dict[tuple[int, ...], int] = {}
    for at, block in enumerate(found):
        if at:
            before = found[at - 1].path
            common = 0
            for a, b in zip(before, block.path):
                if a != b:
                    break
                common += 1
            steps = len(before) + len(block.path) - 2 * common
            edges.append((at - 1, at, NEAR * FADE**steps))
        parent = block.path[:-1]
        if parent in last and last[parent] != at - 1:
            edges.append((last[parent], at, SAME))
        last[parent] = at
    return edges


def minimum_cut(odds: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source, at the least cost: positive odds are the capacity
    from the source, negative odds that to the sink.

    A node whose odds outweigh all its edges is on their side in some minimum cut;
    it is taken out, its edges turn into odds of its neighbours, and so on.  What remains
    goes through augmenting paths in layers.  Of several minimum cuts the one with the
    fewest nodes at the source is taken, but for nodes that were taken out.
    """
    count = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(count)]
    for a, b, capacity in edges:
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + capacity
            near[b][a] = near[b].get(a, 0.0) + capacity
    label: list[bool | None] = [None] * count
    waiting = deque(range(count))
    while waiting:
        at = waiting.popleft()
        if label[at] is None and abs(odds[at]) >= sum(near[at].values()):
            label[at] = odds[at] > 0
            for other, capacity in near[at].items():
                odds[other] += capacity if label[at] else -capacity
                del near[other][at]
                waiting.append(other)
            near[at] = {}
    rest = [at for at in range(count) if label[at] is None]
    if rest:
        _augment(rest, odds, near, label)
    return [bool(x) for x in label]


def _augment(rest: list[int], odds: list[float], near: list[dict[int, float]], label: list) -> None:
    """Dinic's method on the residual capacities; ``near`` holds them between nodes."""
    source = {at: odds[at] for at in rest if odds[at] > 0}
    sink = {at: -odds[at] for at in rest if odds[at] < 0}
    while True:
        level = {at: 0 for at, capacity in source.items() if capacity > 1e-12}
        queue, reached = deque(level), False
        while queue:
            at = queue.popleft()
            reached = reached or sink.get(at, 0.0) > 1e-12
            for other, capacity in near[at].items():
                if capacity > 1e-12 and other not in level:
                    level[other] = level[at] + 1
                    queue.append(other)
        if not reached:
            for at in rest:
                label[at] = at in level
            return
        ways = {at: iter(list(near[at])) for at in level}
        for start in [at for at in level if source.get(at, 0.0) > 1e-12]:
            path = [start]
            while path and source[start] > 1e-12:
                at = path[-1]
                if sink.get(at, 0.0) > 1e-12:
                    flow = min(source[start], sink[at], *(near[a][b] for a, b in zip(path, path[1:])))
                    source[start] -= flow
                    sink[at] -= flow
                    for a, b in zip(path, path[1:]):
                        near[a][b] -= flow
                        near[b][a] = near[b].get(a, 0.0) + flow
                    full = next((k for k, (a, b) in enumerate(zip(path, path[1:])) if near[a][b] <= 1e-12), len(path) - 1)
                    path = path[: full + 1]
                    continue
                for other in ways[at]:
                    if level.get(other) == level[at] + 1 and near[at][other] > 1e-12:
                        path.append(other)
                        break
                else:
                    level[at] = -1
                    path.pop()


def main_text(page: str | None) -> str:
    """The main text of a page; empty for null, for a page without text and for one without content."""
    if not page:
        return ""
    found = blocks(page)
    kept = minimum_cut([block.odds for block in found], edges_of(found))
    return " ".join(block.text for block, content in zip(found, kept) if content)


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row, from its whole HTML.

    Null and empty pages have an empty text; null ids and urls are kept, repeated rows
    stay apart, other columns are not read.
    """
    ship(pages.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), html_col)
    return chosen.mapInArrow(run, f"page_id {kinds[id_col]}, url {kinds[url_col]}, text string, n_chars long")
