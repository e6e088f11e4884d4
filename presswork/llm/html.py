"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules, and a renderer.

The builder keeps the stack of open elements: text and what isn't head matter close an open head, block starts close an
open paragraph, list items, cells, rows, options and definition terms close their like, end tags close what is open inside their element and are ignored
where it isn't open. Not rendered: head matter (title, style, script, template, ...), ``hidden``,
``display: none`` and closed ``dialog`` elements with all inside, what stands in a closed ``details`` beside its summary, and ``visibility: hidden`` text until an inner element is
visible again. Everything else that is text is rendered:

* inline white space folds to one blank, but is kept in ``pre`` and ``textarea``; ``br`` breaks a line;
* blocks begin and end lines, and those that have margins (paragraphs, headings, lists, tables, ...) stand
  apart by one empty line;
* list items carry ``- `` or their number, two blanks further in per level;
* of svg the text of ``text`` and the HTML in ``foreignObject`` is rendered, of math all text: in the line, parted by a blank
  from other labels and cells; not their titles, descriptions, annotations and what is shown only where others refer to it
  (``defs``, ``symbol``, clips, masks, markers, patterns); all branches of a ``switch`` are;
* table cells are padded to the width of their column and parted by `` | ``; a cell of several
  lines makes the row as high; spanned columns share their cell's width, and spanned rows leave their cell's columns blank. Wide
  characters count two columns and combining ones none;
* an ``object`` shows what stands in it, as its file isn't fetched; style sheets aren't read, only ``style`` attributes.

Defined cases: a null page gives a null text, an empty one or one without visible text the empty text; unclosed comments,
tags and elements end with the page; no nesting depth is too much (no recursion); columns other than page_id,
url and html are left alone; repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_slices

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>?",
    re.DOTALL,
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_FONT = re.compile(r"(?:^|[\s\"'/])(?:color|face|size)(?=[\s=/]|$)", re.IGNORECASE)
_FOLD = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never rendered.
NOTHING = frozenset("head title style script template noembed noframes iframe audio video canvas datalist base link meta".split())
#: Their content is text up to the end tag, whatever it looks like.
RAW = frozenset("script style title textarea noembed noframes iframe xmp".split())
#: Blocks; the ones with margins stand apart.
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset menu dir xmp".split())
BLOCKS = APART | frozenset(
    "html body div section article aside header footer main nav address form details summary dialog li dt dd "
    "figcaption legend option optgroup select center hgroup search caption tr td th tbody thead tfoot".split()
)
#: What a start tag closes, up to the elements that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "caption": ({"caption"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: A paragraph isn't looked for beyond these.
SCOPE = frozenset("td th table caption button html object".split()) | frozenset(
    ["svg foreignobject", "svg desc", "svg title", "math mi", "math mo", "math mn", "math ms", "math mtext", "math annotation-xml"]
)
#: Parts of svg and math that aren't shown, or only where others refer to them.
UNSHOWN = frozenset(
    [f"svg {t}" for t in "title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter style script".split()]
    + ["math annotation", "math annotation-xml"]
)
#: Their content is HTML again.
HTML_INSIDE = frozenset(["svg foreignobject", "svg desc", "svg title", "math mi", "math mo", "math mn", "math ms", "math mtext"])
#: Start tags that end svg and math.
BREAKS_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Any other start tag, and text, ends an open head.
HEAD = frozenset("base link meta title style script template noscript noframes".split())
SPACE = " \t\n\f\r"


class Flow:
    """Lines under way: one for the page, one for each table cell."""

    __slots__ = ("lines", "parts", "blank", "gap", "marker", "indent")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False  # the line so far ends in white space that may yet count
        self.gap = False  # an empty line is due before the next line
        self.marker, self.indent = "", 0

    def text(self, s: str) -> None:
        folded = _FOLD.sub(" ", s)
        if folded[:1] == " ":
            self.blank, folded = bool(self.parts), folded[1:]
        if not folded:
            return
        if self.blank:
            self.parts.append(" ")
        self.blank = folded[-1] == " "
        self.parts.append(folded[:-1] if self.blank else folded)

    def kept(self, s: str) -> None:
        first, *more = s.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.parts.append(first)
        for line in more:
            self.end(True)
            self.parts.append(line)

    def end(self, forced: bool = False) -> None:
        """End the line; an empty one only if forced."""
        if self.parts or forced:
            line = "".join(self.parts)
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append((" " * self.indent + self.marker + line).rstrip(" "))
            self.parts = []
            if self.marker:
                self.indent, self.marker = self.indent + len(self.marker), ""
        self.blank = False

    def part(self) -> None:
        """A blank is due before more text of the line."""
        self.blank = bool(self.parts)

    def apart(self) -> None:
        self.end()
        self.gap = bool(self.lines)

    def done(self) -> list[str]:
        self.end()
        return self.lines


class Table:
    __slots__ = ("rows", "caption")

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []  # cells: lines, columns, rows
        self.caption: list[str] = []

    def grid(self) -> list[list[tuple[int, list[str], int]]]:
        """Rows of (first column, lines, columns), cells placed beside those that reach down from rows above."""
        out, down = [], {}  # column -> rows that are taken yet
        for r in self.rows:
            at, row = 0, []
            for lines, span, deep in r:
                while down.get(at):
                    at += 1
                row.append((at, lines, span))
                for k in range(at, at + span):
                    down[k] = max(down.get(k, 0), deep)
                at += span
            out.append(row)
            down = {k: n - 1 for k, n in down.items() if n > 1}
        return out

    def lines(self) -> list[str]:
        rows = [r for r in self.grid() if any(any(lines) for _, lines, _ in r)]
        wide = max((at + span for r in rows for at, _, span in r), default=0)
        width = [0] * wide
        for single in (True, False):
            for r in rows:
                for at, lines, span in r:
                    need = max(map(columns, lines), default=0)
                    have = sum(width[at : at + span]) + 3 * (span - 1)
                    if (span == 1) == single and need > have:
                        width[at + span - 1] += need - have
        out = list(self.caption)
        for r in rows:
            for k in range(max((len(lines) for _, lines, _ in r), default=0)):
                upto, cells = 0, []
                for at, lines, span in r:
                    cells += [" " * width[c] for c in range(upto, at)]
                    room = sum(width[at : at + span]) + 3 * (span - 1)
                    line = lines[k] if k < len(lines) else ""
                    cells.append(line + " " * (room - columns(line)))
                    upto = at + span
                out.append(" | ".join(cells).rstrip(" "))
        return out


def columns(line: str) -> int:
    """The columns a line takes on a terminal."""
    if line.isascii():
        return len(line)
    return sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in line)


def _given(attrs: str) -> dict[str, str]:
    given: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        given.setdefault(name.lower(), value[1:-1] if value[:1] in "\"'" else value)
    return given


def _number(given: dict[str, str], name: str, least: int = 0) -> int:
    """A span as a page gives it; ``least`` where it gives none."""
    v = given.get(name, "")
    return min(65534, int(v)) if re.fullmatch(r"[0-9]{1,9}", v) else least


def _closes_itself(attrs: str) -> bool:
    """Whether the tag ends in a slash that isn't the end of an unquoted value."""
    if not attrs.endswith("/"):
        return False
    last = None
    for last in _ATTR.finditer(attrs):
        pass
    return last is None or last.end() < len(attrs)


def _shown(given: dict[str, str], style: str, none: bool, seen: bool) -> tuple[bool, bool]:
    style = re.sub(r"\s+", "", entities.unescape(style)).lower()
    if "visibility:hidden" in style or "visibility:collapse" in style:
        seen = False
    elif "visibility:visible" in style:
        seen = True
    return none or "hidden" in given or "display:none" in style, seen


class _Open:
    """An open element and what to do when it closes."""

    __slots__ = ("tag", "none", "seen", "pre", "count", "flow", "table", "span", "deep", "indent", "space", "mute", "parted")

    def __init__(self, tag: str, none: bool, seen: bool, pre: bool):
        self.tag, self.none, self.seen, self.pre = tag, none, seen, pre
        self.count, self.flow, self.table, self.span, self.deep, self.indent = 0, None, None, 1, 1, None
        self.space, self.mute, self.parted = "", False, None  # svg or math if its content is; text right inside isn't shown; what parts it


class Renderer:
    def __init__(self) -> None:
        self.stack = [_Open("#", False, True, False)]
        self.flows = [Flow()]
        self.tables: list[Table] = []
        self.open: Counter[str] = Counter()  # open elements by tag, so that looking for one that isn't costs nothing

    def page(self, source: str) -> str:
        at, n = 0, len(source)
        while at < n:
            m = _TOKEN.search(source, at)
            if not m:
                self.text(source[at:])
                break
            if m.start() > at:
                self.text(source[at : m.start()])
            at = m.end()
            if m.group("start"):
                tag = m.group("start").lower()
                self.start(tag, m.group("attrs"))
                if tag in RAW and self.stack[-1].tag == tag:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(source, at)
                    body = source[at : close.start()] if close else source[at:]
                    if tag in ("textarea", "xmp"):
                        self.text(body, tag == "xmp")
                    self.end(tag)
                    at = close.end() if close else n
            elif m.group("end"):
                self.end(m.group("end").lower())
            elif m.group("cdata"):
                self.text(m.group("cdata"), True)
        while len(self.stack) > 1:
            self.pop()
        lines = self.flows[0].done()
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)

    def text(self, s: str, literal: bool = False) -> None:
        if self.stack[-1].tag == "head" and s.strip(SPACE):
            self.pop()
        top = self.stack[-1]
        if top.none or not top.seen or top.mute or (top.space == "math" or top.tag in ("table", "tbody", "thead", "tfoot", "tr")) and not s.strip():
            return
        if not literal and "&" in s:
            s = entities.unescape(s)
        (self.flows[-1].kept if top.pre else self.flows[-1].text)(s)

    def start(self, tag: str, attrs: str) -> None:
        # implied end tags
        if self.stack[-1].tag == "head" and tag not in HEAD:
            self.pop()
        if self.stack[-1].space:
            if tag not in BREAKS_OUT and not (tag == "font" and _FONT.search(attrs)):
                return self.foreign(self.stack[-1].space, tag, attrs)
            while self.stack[-1].space:
                self.pop()
        elif tag in ("svg", "math"):
            return self.foreign(tag, tag, attrs)
        if tag in BLOCKS and tag not in ("html", "body", "option", "optgroup"):
            self._close_if({"p"}, SCOPE)
        if tag in CLOSES:
            self._close_if(*CLOSES[tag])
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop()
        # implied start tags
        if tag in ("td", "th") and self.tables and not (self.open["tr"] and any(e.tag == "tr" for e in self._inside_table())):
            self.start("tr", "")
        top = self.stack[-1]
        none, seen = top.none or tag in NOTHING, top.seen
        pre = top.pre or tag in ("pre", "textarea", "xmp")
        given: dict[str, str] = {}
        if attrs and not attrs.isspace():
            given = _given(attrs)
            if tag == "input" and given.get("type", "").lower() == "hidden":
                none = True
            none, seen = _shown(given, given.get("style", ""), none, seen)
        if tag == "dialog" and "open" not in given or top.tag == "details" and not top.count and tag != "summary":
            none = True
        if tag in VOID:
            if not none and tag == "br":
                self.flows[-1].end(True)
            elif not none and tag == "hr":
                self.flows[-1].apart()
            return
        el = _Open(tag, none, seen, pre)
        if tag == "details":  # its text is shown if it is open; its first summary always
            el.count, el.mute = int("open" in given), "open" not in given
        self.stack.append(el)
        self.open[tag] += 1
        if none:
            return
        flow = self.flows[-1]
        if tag == "table":
            flow.apart()
            el.table = Table()
            self.tables.append(el.table)
        elif tag in ("td", "th", "caption") and self.tables:
            el.flow = Flow()
            el.span, el.deep = min(1000, _number(given, "colspan") or 1), _number(given, "rowspan", 1)
            if not el.deep:  # down to the end of its part of the table
                el.deep = 65534
            self.flows.append(el.flow)
        elif tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
        elif tag in ("ul", "ol", "menu", "dir"):
            if self.open["li"]:
                flow.end()
            else:
                flow.apart()
            el.count = int(given["start"]) - 1 if re.fullmatch(r"-?\d{1,9}", given.get("start", "")) else 0
        elif tag == "li":
            flow.end()
            parent = None
            if any(self.open[t] for t in ("ul", "ol", "menu", "dir")):
                parent = next(e for e in reversed(self.stack) if e.tag in ("ul", "ol", "menu", "dir"))
            el.indent = flow.indent
            if parent is not None and parent.tag == "ol":
                parent.count = int(given["value"]) if re.fullmatch(r"-?\d{1,9}", given.get("value", "")) else parent.count + 1
                flow.marker = f"{parent.count}. "
            else:
                flow.marker = "- "
        elif tag in ("dd", "blockquote"):
            (flow.apart if tag == "blockquote" else flow.end)()
            el.indent = flow.indent
            flow.indent += 2
        elif tag in APART:
            flow.apart()
        elif tag in BLOCKS:
            flow.end()

    def foreign(self, space: str, tag: str, attrs: str) -> None:
        """An element of svg or math, named by both."""
        top, name, given = self.stack[-1], f"{space} {tag}", _given(attrs)
        none, seen = top.none or name in UNSHOWN, top.seen
        style = given.get("style", "")
        if space == "svg":
            style = ";".join([*(f"{k}:{given[k]}" for k in ("display", "visibility") if k in given and k + ":" not in style), style])
        none, seen = _shown(given, style, none, seen)
        el = _Open(name, none, seen and name != "math mphantom", False)
        el.space = "" if name in HTML_INSIDE else space
        if space == "svg":
            el.mute = tag == "svg" or top.mute and tag not in ("text", "foreignobject")
        if tag in ("text", "foreignobject") or tag == "tspan" and ("x" in given or "y" in given) or tag in ("mtr", "mtd", "mlabeledtr"):
            el.parted = Flow.part
        elif name == "math math" and given.get("display", "").lower() == "block":
            el.parted = Flow.end
        self.stack.append(el)
        self.open[name] += 1
        if el.parted and not none:
            el.parted(self.flows[-1])
        if _closes_itself(attrs):
            self.pop()

    def end(self, tag: str) -> None:
        if " " in self.stack[-1].tag:
            if tag in ("br", "p"):
                while self.stack[-1].space:
                    self.pop()
            elif self.open["svg " + tag] or self.open["math " + tag]:
                for e in reversed(self.stack):
                    if " " not in e.tag:
                        break
                    if e.tag.partition(" ")[2] == tag:
                        while self.pop() != e.tag:
                            pass
                        return None
        if tag == "br":
            return self.start("br", "")
        if tag == "p" and not self._open("p", SCOPE):
            return self.flows[-1].apart() if not self.stack[-1].none else None
        if tag in HEADINGS:
            if self._any(HEADINGS):
                while self.pop() not in HEADINGS:
                    pass
            return None
        stop = SCOPE - {tag} if tag not in ("table", "html", "body") else frozenset()
        if self._open(tag, stop):
            while self.pop() != tag:
                pass
        return None

    def _open(self, tag: str, stop: frozenset[str]) -> bool:
        if not self.open[tag]:
            return False
        for e in reversed(self.stack):
            if e.tag == tag:
                return True
            if e.tag in stop:
                return False
        return False

    def _any(self, tags: frozenset[str]) -> bool:
        if not any(self.open[t] for t in tags):
            return False
        for e in reversed(self.stack):
            if e.tag in tags:
                return True
            if e.tag in SCOPE:
                return False
        return False

    def _close_if(self, tags: set[str], stop: set[str] | frozenset[str]) -> None:
        """Close up to the outermost of ``tags`` that is open inside ``stop``."""
        if not any(self.open[t] for t in tags):
            return
        found = 0
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in stop:
                break
            if self.stack[k].tag in tags:
                found = k
        while found and len(self.stack) > found:
            self.pop()

    def _inside_table(self) -> list[_Open]:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k].tag == "table":
                return self.stack[k:]
        return []

    def pop(self) -> str:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if e.none:
            return e.tag
        flow = self.flows[-1]
        if e.flow is not None:
            self.flows.pop()
            lines = e.flow.done()
            if e.tag == "caption":
                self.tables[-1].caption = lines
            else:
                if not self.tables[-1].rows:
                    self.tables[-1].rows.append([])
                self.tables[-1].rows[-1].append((lines, e.span, e.deep))
        elif e.table is not None:
            flow.end()
            self.tables.pop()
            for line in e.table.lines():
                flow.parts.append(line)
                flow.end(True)
            flow.gap = bool(flow.lines)
        elif e.parted:
            e.parted(flow)
        elif e.tag == "li":
            flow.end()
            flow.marker, flow.indent = "", e.indent
        elif e.tag in ("ul", "ol", "menu", "dir"):
            flow.end()
            if not self.open["li"]:
                flow.gap = bool(flow.lines)
        elif e.tag in APART:
            flow.apart()
        elif e.tag in BLOCKS:
            flow.end()
        if e.indent is not None and e.tag != "li":
            flow.indent = e.indent
        return e.tag


def render(source: str | None) -> str | None:
    return None if source is None else Renderer().page(source)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_lines of every page. Row-local."""

    def run(part: pa.RecordBatch) -> dict[str, object]:
        texts = [render(h) for h in part.column("html").to_pylist()]
        lines = [None if t is None else t.count("\n") + 1 if t else 0 for t in texts]
        return {"page_id": part.column("page_id"), "url": part.column("url"), "text": texts, "n_lines": lines}

    picked = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    return by_slices(picked, run, "page_id long, url string, text string, n_lines long", "html")
