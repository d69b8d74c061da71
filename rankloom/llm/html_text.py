"""Main text of web pages by tree scoring.

A page is parsed into a light element tree; scripts, form controls and hidden elements are dropped on the way.

1. Parts: elements whose tag, role or name (the words of class and id) marks a menu, header, footer, sidebar, form, advert,
   notice or reader comments are set apart. A name is only a hint: where the rest of the page holds next to nothing, a named part
   that holds the text is a wrapper and counts as the rest does. Words of a state ("with-sidebar", "comments-open") mark nothing.
2. Scores: every paragraph gives points for its length and its commas to its container, half of them to the next ancestor
   and so on. A container's points, with what its tag and name are worth, are discounted by its share of link text.
3. The best container is kept, and grows to its parent while what that adds is text rather than links, up to an article or main element.
   Siblings that score or read like it are kept too.

All steps are single passes over the elements, however deep they are nested. A null or empty page has an empty text. Broken markup
follows the usual recovery: implied ends of paragraphs, list items and cells, stray end tags ignored, an unfinished tag at
the end dropped. Pages are read whole; rows are independent, so ties, repeated rows and extra columns need no rule (of equal containers the
outer one wins). An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:-->|--!>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|/[^>]*(?:>|\Z))""", re.S)
ATTR = re.compile(r"""([A-Za-z_:][\w:.-]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

# HTML element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CUT = frozenset("script style noscript template iframe object embed svg math canvas audio video head title button select textarea input noembed noframes map".split())
PART = frozenset("nav footer aside dialog menu".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
BARRIER = frozenset("html table td th caption button object template".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPH = frozenset("p pre td li blockquote dd dt figcaption".split())
# Names, in class or id, of parts that are not article text.
BAD_NAME = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split())
BAD_ARTICLE = frozenset("ad ads advert advertisement comment comments promo related reply respond sponsored".split())
BAD_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Names of layout, which also stand on wrappers; parts with these need less text to be taken for one.
LAYOUT = frozenset("banner footer header masthead menu nav navbar navigation notice notices sidebar toolbar widget".split())
GOOD_NAME = frozenset("article body content entry hentry main page post story text".split())
STATE = re.compile(r"(?<![\w-])(?:with|has|no|is|without|hide|show)-[\w-]+|[\w-]+-(?:open|closed|enabled|disabled|on|off|free)(?![\w-])")
START = {"div": 5, "article": 10, "main": 8, "section": 3, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "th": -5}
NAME_POINTS = 10
#: Share of a container's points that its parent gets.
DECAY = 0.5
#: A named part with this many characters (LAYOUT, other names) beside text outside all parts of at most that share of it is a wrapper.
WRAPPER, REST = (100, 400), (0.2, 0.0)
#: Shorter paragraphs give no points (they are kept with their container all the same).
LEAST_CHARS = 25
#: Link share up to which what a parent adds is text; share of the best score with which a sibling is kept, and least score.
LINKS, SIBLING, LEAST_SCORE = 0.3, 0.2, 10.0
COMMAS = re.compile("[,،、，;]")


class _Node:
    __slots__ = ("tag", "up", "cut", "names", "part", "art", "p_open", "head", "zone", "points", "chars", "linked")

    def __init__(self, tag: str, up: _Node | None, cut: bool, names: frozenset, part: int):
        self.tag, self.up, self.cut, self.names, self.part = tag, up, cut, names, part
        self.points, self.chars, self.linked = 0.0, 0, 0
        self.art = tag in ("article", "main") or (up is not None and up.art)
        self.p_open = tag == "p" or (up is not None and up.p_open and tag not in BARRIER)
        # in an article's header: 1, in a heading of it: 2
        self.head = 0 if up is None else up.head
        if tag == "header" and not self.head:
            self.head = 1
        elif tag in HEADING and self.head:
            self.head = 2
        self.zone: _Node | None = None


#: How a part was told: not at all, by a layout name, by another name or role, by its tag.
NONE, LAYOUT_NAME, OTHER_NAME, BY_TAG = range(4)


def _attributes(tag: str, src: str) -> tuple[frozenset, bool, int]:
    """Names in class and id; whether the element is hidden; whether its names or role mark a part."""
    if "=" not in src and "hidden" not in src:
        return frozenset(), False, LAYOUT_NAME if tag == "form" else NONE
    at = {}
    for k, a, b, c in ATTR.findall(src):
        at.setdefault(k.lower(), a or b or c)
    said = STATE.sub(" ", f"{at.get('class', '')} {at.get('id', '')}")
    names = frozenset(x.lower() for x in NAME.findall(said))
    if tag in ("html", "body"):
        return names, False, NONE
    style = at.get("style", "").replace(" ", "").lower()
    hidden = "hidden" in at or at.get("aria-hidden") == "true" or "display:none" in style
    bad = names & (BAD_ARTICLE if tag in ("article", "main", *HEADING) else BAD_NAME)
    part = NONE
    if bad or at.get("role", "").lower() in BAD_ROLE or tag == "form":
        part = LAYOUT_NAME if bad <= LAYOUT else OTHER_NAME
    return names, hidden, part


def _parse(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """Elements, parents first, and text blocks in page order: block element, text, characters in links."""
    top = _Node("html", None, False, frozenset(), NONE)
    stack, nodes, blocks = [top], [top], []
    opened: Counter[str] = Counter()
    buf: list[str] = []
    linked = [0, 0]  # open links; characters of the block in links

    def flush() -> None:
        if buf:
            text = " ".join("".join(buf).split())
            buf.clear()
            if text:
                node = next(x for x in reversed(stack) if x.tag not in INLINE)
                blocks.append((node, text, min(linked[1], len(text))))
        linked[1] = 0

    def pop(to: int) -> None:
        for x in stack[to:]:
            opened[x.tag] -= 1
            if x.tag == "a" and not x.cut:
                linked[0] -= 1
        del stack[to:]

    def add(raw: str) -> None:
        if raw and not stack[-1].cut:
            text = html.unescape(raw) if "&" in raw else raw
            buf.append(text)
            if linked[0]:
                linked[1] += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        if m[2] is None and not m[0].endswith(">"):
            break  # an unfinished tag
        tag, closing, rest = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        block = tag not in INLINE
        if closing:
            if block:
                flush()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    pop(k)
                    break
                if not block and stack[k].tag not in INLINE or stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "tbody", "body", "html"):
                    break
            continue
        if tag == "br":
            if not stack[-1].cut:
                buf.append(" ")
            continue
        if block:
            flush()
        if tag in VOID or tag == "html":
            continue
        if tag in CLOSES_P and stack[-1].p_open:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    pop(k)
                    break
                if stack[k].tag in BARRIER:
                    break
        if tag in IMPLIED:
            ends, until = IMPLIED[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in until:
                    break
                if stack[k].tag in ends:
                    pop(k)
                    if tag != "tr":
                        break
        if tag == "body":  # a head that was not closed ends here
            pop(1)
        up = stack[-1]
        names, hidden, part = _attributes(tag, rest)
        # an article's own header holds its headline; what else is in it goes in main_text
        if tag in PART or tag == "header" and not up.art:
            part = BY_TAG
        node = _Node(tag, up, up.cut or hidden or tag in CUT, names, part)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = n if end is None else (page.find(">", end.end()) + 1 or n)
            continue
        if rest.endswith("/") and tag in ("svg", "path"):
            continue
        if tag == "a" and not node.cut:
            linked[0] += 1
        opened[tag] += 1
        stack.append(node)
        if not node.cut:
            nodes.append(node)
    flush()
    return nodes, blocks


def _zones(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Set the innermost part that each element lies in (None: the page itself); wrappers are no parts."""
    for _ in range(2):
        held: dict[_Node | None, int] = {}
        for x in nodes:
            x.zone = x if x.part else x.up.zone if x.up is not None else None
        for node, text, linked in blocks:
            if node.head != 1 and len(text) >= LEAST_CHARS:
                held[node.zone] = held.get(node.zone, 0) + len(text) - linked
        rest = held.pop(None, 0)
        named = [x for x in held if x.part != BY_TAG and held[x] >= WRAPPER[x.part - 1] and rest <= REST[x.part - 1] * held[x]]
        if not named:
            return
        x = max(named, key=held.get)  # of equals the outer one
        while x is not None:
            if x.part == BY_TAG:
                return
            x.part = NONE
            x = x.up.zone if x.up is not None else None


def _score(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> None:
    """Points, characters and characters in links of every element, bottom-up."""
    for node, text, linked in blocks:
        node.chars += len(text)
        node.linked += linked
        if len(text) >= LEAST_CHARS and node.tag not in HEADING:
            up = node.up if node.tag in PARAGRAPH and node.up is not None else node
            up.points += (1 + len(COMMAS.findall(text)) + min(len(text) // 100, 3)) * (1 - linked / len(text))
    for x in reversed(nodes):
        up = x.up
        if up is not None and x.zone is None:
            up.points += DECAY * x.points
            up.chars += x.chars
            up.linked += x.linked


def _rank(x: _Node) -> float:
    bonus = START.get(x.tag, 0) + (NAME_POINTS if x.names & GOOD_NAME else 0) - (NAME_POINTS if x.names & BAD_NAME else 0)
    return (x.points + bonus) * (1 - x.linked / max(x.chars, 1))


def main_text(page: str | None) -> str:
    """The main text of one page, blocks joined by a line feed."""
    nodes, blocks = _parse(page or "")
    _zones(nodes, blocks)
    blocks = [x for x in blocks if x[0].zone is None and x[0].head != 1]
    if not blocks:
        return ""
    _score(nodes, blocks)
    scored = [x for x in nodes if x.points > 0 and x.zone is None]
    if scored:
        best = max(scored, key=_rank)  # of equals the first in page order
    else:
        some = [x for x in nodes if x.chars and x.zone is None]
        best = max(some, key=lambda x: (x.tag in ("article", "main"), x.chars - x.linked))
    least = max(LEAST_SCORE, SIBLING * best.points)
    while best.tag not in ("article", "main", "body", "html") and best.up is not None:
        if best.up.tag in ("body", "html"):
            break
        more = best.up.chars - best.chars
        if more and (best.up.linked - best.linked) / more > LINKS:
            break
        best = best.up

    def reads(side: _Node) -> bool:
        """Whether a sibling scores or reads like the best container."""
        share = side.linked / max(side.chars, 1)
        if side.points * (1 - share) >= least:
            return True
        return side.tag in PARAGRAPH | {best.tag, *HEADING} and (side.chars > 80 and share < 0.25 or share == 0)

    sure, keeps = best.tag in ("article", "main"), {best: True}
    for x in nodes:
        if x is not best and x.up is not None:
            keeps[x] = keeps.get(x.up, False) or not sure and x.up is best.up and reads(x)
    return "\n".join(text for node, text, linked in blocks if keeps.get(node, False))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """pages without `html_col`, with `out_col` (main text) and n_chars (its code points)."""
    rest = [c for c in pages.columns if c not in (html_col, out_col, "n_chars")]
    src = pages.select(*rest, F.col(html_col).cast("string").alias("__html"))
    schema = src.drop("__html").schema.add(out_col, "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tc.slices(batches, "__html", 8 << 20):
            k = b.schema.get_field_index("__html")
            texts = [main_text(x) for x in b.column(k).to_pylist()]
            cols = [c for i, c in enumerate(b.columns) if i != k]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, out_col, "n_chars"])

    return src.mapInArrow(run, schema)
