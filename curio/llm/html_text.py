"""Operator 4, HTML extraction by layout-aware rendering.

``Tree`` builds elements from the tags with the implied end tags of HTML (a new ``li``
ends the open one, a block ends an open ``p``, table parts end each other, the end
of an element ends what is open in it); a stray end tag is ignored. The first content
that is none of the head's ends an open head. A cell without a row gets one; text and
other elements that stand in a table outside its cells come before the table, and a
form there owns nothing, as in browsers. ``render`` walks the tree without recursion and
emits all visible text: scripts, styles, templates, hidden and ``display:none``
elements are not visible, nor are frames, titles and the definitions in a drawing; the
text of ``svg`` and ``math`` and what an ``object`` holds in place of itself are.
``visibility`` is inherited and may be turned on again inside. Rules of the page's own
style blocks count for these two properties where their selectors are a tag, classes and
ids of one element (``.h``, ``p.x#y``), by weight and order; other selectors and at-rules
are passed over. Blocks stand on lines of their own, paragraphs and headings
with an empty line around them, ``br`` breaks a line, list items are marked ``-`` or
numbered (``start``, ``value``), their further lines indented below the first, options stand
apart, ``pre`` keeps its spaces, and table cells are padded to the width of their columns;
``colspan`` and ``rowspan`` move what follows, as in browsers. An end tag inside a cell
ends nothing outside it. A comment that is never closed reaches to the end. Character
references are resolved.

Defined results: null or empty html gives the empty text; text without tags is itself,
spaces joined. Broken markup never fails. Repeated rows are rendered each; other
columns pass through, one with the name of the output gives way. No page is cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from curio.llm.common import ship, sliced, texts_of, with_fields

ship(__name__)

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = set("script style template noscript head title iframe datalist".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead "
             "tr caption ul".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
ENDS_P = BLOCKS - set("html body tbody tfoot thead tr caption li dd dt".split())
# a start tag ends the open elements on the right, unless one of the walls is nearer
IMPLIED = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select"),
           "tr": ("tr td th caption", "table"), "td": ("td th caption", "tr table"), "th": ("td th caption", "tr table"),
           "tbody": ("tbody thead tfoot tr td th caption", "table"), "thead": ("tbody thead tfoot tr td th caption", "table"),
           "tfoot": ("tbody thead tfoot tr td th caption", "table")}
PARTS = set("table tbody thead tfoot tr".split())  # where only parts of a table may stand
IN_TABLE = set("caption colgroup col tbody thead tfoot tr td th script style template".split())
IN_HEAD = set("base link meta title style script noscript template".split())
FOREIGN_UNSEEN = {"svg": set("desc metadata defs symbol".split()), "math": {"annotation", "annotation-xml"}}
OPTIONS = {"option", "optgroup", "select"}
CELL_WALLS = {"td", "th", "caption", "table"}
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534  # fixed by HTML
DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
BRACE, AT_RULE_ENDS = re.compile(r"[{}]"), re.compile(r"[;{]")
SIMPLE = re.compile(r"([a-z][a-z0-9]*|\*)?((?:[.#][\w-]+)*)", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


def declared(text: str):
    """(property, value, important) for each display and visibility declaration."""
    return [(p.lower(), v.lower(), bool(i)) for p, v, i in DECLARED.findall(text)]


class Styles:
    """Display and visibility rules of style blocks, filed under an id, class or tag
    that an element must have."""

    def __init__(self, css: str = ""):
        self.filed: dict[str, list] = {}
        css = re.sub(r"/\*.*?(\*/|$)", " ", css, flags=re.S)
        for order, rule in enumerate(_without_at_rules(css).split("}")):
            selectors, _, body = rule.partition("{")
            found = declared(body)
            for selector in selectors.split(",") if found else ():
                fits = SIMPLE.fullmatch(selector.strip())
                if not fits or not fits.group(0):
                    continue
                tag, marks = (fits.group(1) or "*").lower(), re.findall(r"[.#][\w-]+", fits.group(2))
                weight = (sum(m[0] == "#" for m in marks), sum(m[0] == "." for m in marks), tag != "*")
                self.filed.setdefault(marks[0] if marks else tag, []).append((tag, frozenset(marks), weight, order, found))

    def of(self, node: Node) -> dict:
        """The winning value of each property of an element."""
        best: dict[str, tuple] = {}
        if self.filed:
            marks = {"." + c for c in (node.attrs.get("class") or "").split()}
            if node.attrs.get("id"):
                marks.add("#" + node.attrs["id"])
            for name in (*marks, node.tag, "*"):
                for tag, needed, weight, order, found in self.filed.get(name, ()):
                    if tag in ("*", node.tag) and needed <= marks:
                        for prop, value, important in found:
                            best[prop] = max(best.get(prop, ((),)), ((important, False, weight, order), value))
        style = node.attrs.get("style")
        if style:
            for order, (prop, value, important) in enumerate(declared(style)):
                best[prop] = max(best.get(prop, ((),)), ((important, True, (0, 0, 0), order), value))
        return {prop: value for prop, (_, value) in best.items()}

    def displayed(self, node: Node, won: dict) -> bool:
        return not (node.tag in UNSEEN or node.tag == "input" or won.get("display") == "none"
                    or ("hidden" in node.attrs and "display" not in won))


def _without_at_rules(css: str) -> str:
    """``css`` without its at-rules and the blocks that they hold."""
    out, at = [], 0
    while True:
        start = css.find("@", at)
        if start < 0:
            return "".join(out) + css[at:]
        out.append(css[at:start])
        ends = AT_RULE_ENDS.search(css, start)
        at = ends.end() if ends else len(css)
        if not ends or ends.group() == ";":
            continue
        depth = 1
        for brace in BRACE.finditer(css, at):
            depth += 1 if brace.group() == "{" else -1
            if not depth:
                at = brace.end()
                break
        else:
            return "".join(out)


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.css: list[str] = []
        self.feed(html)
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""
        self.close()
        self.styles = Styles("\n".join(self.css))

    def _end(self, tags: set, walls: set) -> None:
        for at in range(len(self.open) - 1, 0, -1):
            tag = self.open[at].tag
            if tag in walls:
                return
            if tag in tags:
                del self.open[at:]
                if len(tags) == 1:
                    return

    def _within(self, tags) -> str | None:
        """The nearest open element of ``tags``."""
        return next((n.tag for n in reversed(self.open) if n.tag in tags), None)

    def _place(self, item) -> None:
        """Adds to the open element; what may not stand in a table's parts goes
        before the table, which is the last child so far."""
        if self.open[-1].tag in PARTS and (isinstance(item, str) or item.tag not in IN_TABLE):
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag == "table":
                    siblings = self.open[at - 1].children
                    siblings[-1:-1] = [" ", item]
                    return
        self.open[-1].children.append(item)

    def handle_starttag(self, tag, attrs):
        if tag in IN_TABLE and tag not in UNSEEN and self._within(PARTS | {"td", "th", "caption"}) in PARTS:
            while self.open[-1].tag not in PARTS:  # what came before the table ends
                self.open.pop()
        if tag in IMPLIED:
            tags, walls = IMPLIED[tag]
            self._end(set(tags.split()), set(walls.split()))
        elif tag in ENDS_P:
            self._end({"p"}, {"td", "th", "li", "table", "button"})
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self.open.pop()
        if tag == "table" and self.open[-1].tag in PARTS:
            self._end({"table"}, set())
        if tag in ("td", "th") and self.open[-1].tag in PARTS - {"tr"}:
            self.handle_starttag("tr", [])
        node = Node(tag, dict(attrs))
        if any(tag in unseen and self._within({outer}) for outer, unseen in FOREIGN_UNSEEN.items()):
            node.attrs["hidden"] = ""
        if tag == "form" and self.open[-1].tag in PARTS:
            return
        if tag == "text":
            self._place(" ")
        self._place(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and self._within({"svg", "math"}):
            self.open.pop()

    def handle_endtag(self, tag):
        self._end({tag}, {"table"} if tag in CELL_WALLS | PARTS and tag != "table" else set() if tag == "table" else CELL_WALLS)
        if tag == "text":
            self._place(" ")

    def handle_data(self, data):
        if self.open[-1].tag == "style" and (self.open[-1].attrs.get("media") or "all").lower() in ("all", "screen"):
            self.css.append(data)
        if not SPACE.sub("", data):
            self.open[-1].children.append(data)
            return
        if self.open[-1].tag == "head":
            self.open.pop()
        self._place(data)


class Lines:
    """Collects text into lines with margins between blocks. Lines within a list item
    are indented; its ``mark`` waits for the first of them."""

    def __init__(self):
        self.lines, self.words, self.margin = [], "", 0
        self.indent = self.mark = ""

    def text(self, data: str, pre: bool) -> None:
        if pre:
            *whole, last = data.split("\n")
            for line in whole:
                self.words += line
                self.cut(keep=True)
            self.words += last
            return
        data = SPACE.sub(" ", data)
        if data.startswith(" ") and (not self.words or self.words.endswith(" ")):
            data = data[1:]
        self.words += data

    def cut(self, margin: int = 0, keep: bool = False) -> None:
        line = self.words.rstrip(" ")
        self.words = ""
        if line.strip() or keep:
            self.lines += [""] * (self.margin if self.lines else 0) + [((self.mark or self.indent) + line).rstrip(" ")]
            self.margin, self.mark = 0, ""
        if not self.mark:
            self.margin = max(self.margin, margin)

    def begin(self, level: int, mark: str) -> None:
        """Starts a list item."""
        if self.mark:  # the item around it has no text before
            self.cut(keep=True)
        self.mark = "  " * max(0, level - 1) + mark
        self.indent = " " * len(self.mark)

    def finish(self, indent: str) -> None:
        """Ends a list item; one without text leaves its mark."""
        self.cut(keep=bool(self.mark))
        self.indent = indent

    def done(self) -> str:
        self.cut()
        return "\n".join(self.lines)


def _number(text, least: int, most: int, other: int) -> int:
    """The whole number at the start of an attribute, within bounds."""
    found = re.match(r"\s*([+-]?\d{1,9})", text or "", re.A)
    return min(max(int(found.group(1)), least), most) if found else other


def _rows(table: Node, styles: Styles, seen: bool):
    """(group, cells) of the rows of a table, not those of tables inside it; each cell
    with whether it is seen."""
    rows, stack = [], [(table, 0, seen)]
    groups = 0
    while stack:
        node, group, seen = stack.pop()
        won = styles.of(node)
        if node is not table and not styles.displayed(node, won):
            continue
        if node is not table:
            seen = _seen(won, seen)
        if node.tag == "tr":
            rows.append((group, [(c, seen) for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")
                                 and styles.displayed(c, styles.of(c))]))
            continue
        if node.tag in ("tbody", "thead", "tfoot"):
            groups += 1
            group = groups
        stack += [(c, group, seen) for c in reversed(node.children)
                  if isinstance(c, Node) and c.tag in ("tr", "tbody", "thead", "tfoot")]
    return rows


def _seen(won: dict, seen: bool) -> bool:
    value = won.get("visibility", "inherit")
    return value == "visible" or (seen and value not in ("hidden", "collapse"))


def _table(node: Node, depth: int, out: Lines, styles: Styles, seen: bool) -> None:
    rows = _rows(node, styles, seen)
    placed, held, last = [], {}, None  # held: column -> first row that is free again
    for at, (group, cells) in enumerate(rows):
        if group != last:
            held, last = {}, group
        column, line = 0, []
        for cell, cell_seen in cells:
            while held.get(column, 0) > at:
                column += 1
            wide = _number(cell.attrs.get("colspan"), 1, MAX_COLSPAN, 1)
            tall = _number(cell.attrs.get("rowspan"), 0, MAX_ROWSPAN, 1) or MAX_ROWSPAN
            line.append((column, column + wide, SPACE.sub(" ", render(cell, depth + 1, styles, cell_seen)).strip()))
            if tall > 1:
                held.update((c, at + tall) for c in range(column, column + wide))
            column += wide
        placed.append(line)
    # columns at which no cell starts take no place of their own
    starts = sorted({start for line in placed for start, _, _ in line})
    rank = {start: i for i, start in enumerate(starts)}
    widths = [0] * len(starts)
    lines = [[(rank[start], bisect_left(starts, end), text) for start, end, text in line] for line in placed]
    for line in lines:
        for start, end, text in line:
            if end - start == 1:
                widths[start] = max(widths[start], len(text))
    for line in lines:
        for start, end, text in line:
            short = len(text) - sum(widths[start:end]) - 2 * (end - start - 1)
            if end - start > 1 and short > 0:
                widths[end - 1] += short
    places = list(accumulate((w + 2 for w in widths), initial=0))
    for child in node.children:  # captions and text that stands outside the rows
        if isinstance(child, str):
            out.text(child if seen else "", False)
        elif child.tag not in ("tr", "tbody", "thead", "tfoot") and styles.displayed(child, styles.of(child)):
            out.text(render(child, depth + 1, styles, seen), False)
        out.cut()
    for line in lines:
        for start, _, text in line:
            out.words = out.words.ljust(places[start]) + text
        out.cut()


def render(root: Node, depth: int = 0, styles: Styles = Styles(), seen: bool = True) -> str:
    """Visible text of an element. Tables nested beyond 20 levels are read as
    plain blocks, so that deep markup cannot exhaust the stack."""
    out = Lines()
    stack: list[tuple] = [("in", root, 0, False, None, seen)]
    counters: dict[int, int] = {}
    while stack:
        what, node, level, pre, parent, seen = stack.pop()
        if what == "text":
            out.text(node if seen else " ", pre)
            continue
        tag = node.tag
        if what == "out":
            if tag == "li" and parent is not None:
                out.finish(parent)
            elif tag in OPTIONS:
                out.text(" ", False)
            else:
                out.cut(1 if tag in SPACED and not (tag in ("ul", "ol") and level > 1) else 0)
            continue
        won = styles.of(node)
        if not styles.displayed(node, won):
            continue
        seen = _seen(won, seen)
        if tag == "br":
            out.cut(keep=True)
            continue
        if tag == "img":
            out.text(" " + (node.attrs.get("alt") or "") + " " if node.attrs.get("alt") and seen else "", False)
            continue
        if tag in OPTIONS:
            out.text(" ", False)
        if tag in BLOCKS and node is not root:
            out.cut(1 if tag in SPACED and not (tag in ("ul", "ol") and level) else 0)
        if tag == "table" and depth < 20:
            _table(node, depth, out, styles, seen)
            out.cut(1)
            continue
        around = parent
        if tag in ("ul", "ol"):
            level += 1
            counters[id(node)] = _number(node.attrs.get("start"), -10**9, 10**9, 1)
        elif tag == "li":
            around = out.indent if seen else None
            number = counters.get(id(parent))
            mark = "- "
            if parent is not None and parent.tag == "ol" and number is not None:
                number = _number(node.attrs.get("value"), -10**9, 10**9, number)
                counters[id(parent)] = number + 1
                mark = f"{number}. "
            if seen:
                out.begin(level, mark)
        pre = pre or tag == "pre"
        if (tag in BLOCKS and node is not root) or tag in OPTIONS or tag == "li":
            stack.append(("out", node, level, pre, around, seen))
        for child in reversed(node.children):
            stack.append(("text", child, level, pre, node, seen) if isinstance(child, str)
                         else ("in", child, level, pre, node, seen))
    return out.done()


def text_of(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree(html)
    return render(tree.root, styles=tree.styles)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the rendered text of ``html_col`` as ``text_col``."""
    schema = with_fields(pages, [T.StructField(text_col, T.StringType(), False)])
    keep, at = schema.names[:-1], pages.columns.index(html_col)

    def run(batches):
        for batch in sliced(batches):
            texts = pa.array([text_of(h) for h in texts_of(batch.column(at))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [texts], names=schema.names)

    return pages.mapInArrow(run, schema)
