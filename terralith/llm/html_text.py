"""All visible text of HTML pages, laid out: a tree builder with implied tags, visibility rules, and a renderer.

Blocks stand on lines of their own, paragraphs and their like between blank
lines; list items carry a bullet or their number and are indented by depth; the
cells of a table are padded so that columns align, also beside cells over several rows; inputs
show their value.  Not visible are elements with ``hidden``,
``display:none`` or ``visibility:hidden`` (in the style attribute or in a rule of a
style element whose selectors are a tag, a class or an id, by the order of the cascade), head, script, style,
template and their like, closed dialogs, the body of closed details, and the options of
a select but the chosen one.  Rules in ``@media`` count where they hold for a screen ``SCREEN``
pixels wide; of media features only widths are known, a query with another one doesn't hold.

Pages are handled one at a time without recursion, tables in tables from the inside out.  The
scanner only moves forward, and open elements are found by tables of their places, so that the
work grows with the length of a page, whatever is in it.  Results in unusual
cases: null or empty HTML gives an empty text; broken markup is repaired or
shown as text; repeated rows are rows of their own; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import slices

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = set("area audio base canvas datalist embed head iframe link meta noembed noframes noscript object param rp script source style template title track video".split())
SPACED = set("address blockquote dl fieldset figure form h1 h2 h3 h4 h5 h6 hr ol p pre table ul".split())
BLOCK = SPACED | set("article aside body caption center dd details dialog dir div dt figcaption footer header hgroup html legend li main menu nav optgroup search section summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCK - set("body html caption dd dt li optgroup tbody td tfoot th thead tr legend".split()) | {"li", "dd", "dt"}
#: A start tag of the key ends open elements of the first set, up to one of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
IMPLIED |= {k: IMPLIED["tbody"] for k in ("thead", "tfoot")} | {k: ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption"}, {"table"}) for k in ("caption", "colgroup")}
SCOPE = set("table td th caption template html body button object".split())
IN_HEAD = set("base link meta title style script noscript template".split())
SCREEN = 1280
#: Types of inputs that show no text of their value; unknown types are text.
UNSHOWN_INPUTS = set("hidden password checkbox radio file color range image".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_BETWEEN = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>][^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_SIMPLE = re.compile(r"[.#]?[-\w]+")
_DECLARED = re.compile(r"(?:^|[;{}])\s*(display|visibility)\s*:\s*([-a-z]+)\s*(!\s*important)?", re.I)
_STOP = re.compile(r"[{};\"']")
_STRING = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*(?:{q}|\n|$)", re.S) for q in "\"'"}
_AT = re.compile(r"@([-\w]+)(.*)", re.S)
_WIDTH = re.compile(r"\(\s*(min|max)-(?:device-)?width\s*:\s*([\d.]+)\s*(px|r?em)\s*\)")


class Node:
    __slots__ = ("tag", "attrs", "below")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.below = tag, attrs, []


def attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """Attributes from a place after a tag's name, and the place after the tag; a quote that nothing closes is a letter.

    last: where the page's last quote of each kind is.
    """
    out: dict[str, str] = {}
    while True:
        at = _BETWEEN.match(page, at).end()
        if page[at : at + 1] in (">", ""):
            return out, at + 1
        name = _ATTRIBUTE.match(page, at)
        at = name.end()
        value = ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote in last and at < last[quote]:
                stop = page.find(quote, at + 1)
                value, at = page[at + 1 : stop], stop + 1
            elif quote:
                found = _UNQUOTED.match(page, at)
                value, at = found[0], found.end()
        out.setdefault(name[0].lower(), html.unescape(value))


def tags(page: str) -> Iterator[tuple[str, str, str, dict[str, str], int]]:
    """(text before, "/" or "", name, attributes, place after); what is told by ``send`` is where to go on.  The name is empty at the end."""
    at, end = 0, len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    begin = 0
    while True:
        open_ = page.find("<", at)
        if open_ < 0:
            yield page[begin:], "", "", {}, end
            return
        after = page[open_ + 1 : open_ + 2]
        if after in ("!", "?") or (after == "/" and not page[open_ + 2 : open_ + 3].isalpha()):
            if after == "/" and page[open_ + 2 : open_ + 3] in (">", ""):
                stop, close = open_ + 2, ">"
            else:
                close = "-->" if page.startswith("<!--", open_) else ">"
                stop = open_ + 2
            found = page.find(close, stop)
            at = end if found < 0 else found + len(close)
            if begin < open_:
                yield page[begin:open_], "", "!", {}, at
            begin = at
            continue
        name = _NAME.match(page, open_ + 1 + (after == "/"))
        if name is None or not name[0][0].isascii():
            at = open_ + 1
            continue
        attrs, stop = attributes(page, name.end(), last)
        stop = min(stop, end)
        told = yield page[begin:open_], "/" if after == "/" else "", name[0].lower(), attrs, stop
        at = begin = stop if told is None else told
        if told is not None:
            yield "", "", "!", {}, at


def parse(page: str) -> tuple[Node, list[str]]:
    """The tree of a page, and the texts of its style elements."""
    root = Node("html", {})
    stack, styles = [root], []
    places: dict[str, list[int]] = {"html": [0]}
    end = len(page)

    def push(node: Node) -> None:
        stack[-1].below.append(node)
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def pop() -> None:
        places[stack.pop().tag].pop()

    def innermost(names: set[str]) -> int:
        return max((places[t][-1] for t in names if places.get(t)), default=0)

    def close(names: set[str], scope: set[str]) -> None:
        """Ends the outermost open element of the names inside the scope, with all in it."""
        bound, found = innermost(scope), end + 1
        for t in names:
            if places.get(t) and places[t][-1] > bound:
                found = min(found, places[t][bisect_right(places[t], bound)])
        while len(stack) > found:
            pop()

    def close_one(tag: str, scope: set[str]) -> None:
        """Ends the innermost open element of the name, unless one of the scope is open in it."""
        if places.get(tag) and places[tag][-1] > innermost(scope):
            found = places[tag][-1]
            while len(stack) > found:
                pop()

    def text(s: str) -> None:
        if not s:
            return
        if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
            pop()
        stack[-1].below.append(html.unescape(s))

    found = tags(page)
    for before, slash, tag, attrs, at in found:
        text(before)
        if tag in ("", "!"):
            continue
        if slash:
            if tag == "p" and not places.get("p"):
                stack[-1].below.append(Node("p", {}))
            elif tag == "br":
                stack[-1].below.append(Node("br", {}))
            elif tag not in ("html", "body"):
                close_one(tag, {"table"} - {tag} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else set() if tag == "table" else {"td", "th", "caption", "table"} - {tag})
            continue
        if tag in ("html", "body", "head"):
            if tag == "html" or (tag == "body" and places.get("body")):
                for k, v in attrs.items():
                    stack[places[tag][0]].attrs.setdefault(k, v)
                continue
            if tag == "head" and (places.get("body") or places.get("head")):
                continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            pop()
        if tag in CLOSES_P:
            close_one("p", SCOPE)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            pop()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push(Node("tr", {}))
        node = Node(tag, attrs)
        if tag in VOID:
            stack[-1].below.append(node)
        elif tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>]|$)", re.I).search(page, at)
            inner = page[at : stop.start() if stop else end]
            stack[-1].below.append(node)
            if tag == "style":
                styles.append(inner)
            elif tag in ("textarea", "xmp"):
                node.below.append(html.unescape(inner) if tag == "textarea" else inner)
            found.send(end if not stop else page.find(">", stop.end()) + 1 or end)
        else:
            push(node)
    return root, styles


#: By selector and property: whether important, the place among the rules, and the value.
Rules = dict[str, dict[str, tuple[bool, int, str]]]


def on_screen(media: str) -> bool:
    """Whether one query of a list of media queries holds."""

    def holds(query: str) -> bool:
        kind, *features = [x.strip() for x in re.split(r"\band\b", query)]
        no = re.match(r"not\b", kind) is not None
        kind = re.sub(r"^(not|only)\b\s*", "", kind)
        if kind.startswith("("):
            features.insert(0, kind)
            kind = "all"
        found = [_WIDTH.fullmatch(x) for x in features]
        if not all(found):
            return False
        sizes = [(m[1], float(m[2]) * (1 if m[3] == "px" else 16)) for m in found if m[2].count(".") < 2 and m[2] != "."]
        return no != (kind in ("all", "screen", "") and len(sizes) == len(found) and all(SCREEN >= x if way == "min" else SCREEN <= x for way, x in sizes))

    return any(map(holds, media.lower().split(",")))


def css_rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and own declarations, without strings, of the rules that hold on a screen, read once by the depth of braces.

    Rules in rules and what follows an at-rule without a block are left out; the end closes what is open.
    """
    open_: list[tuple[str, bool, list[str]]] = []  # selectors, empty for at-rules; whether it holds; declarations
    parts: list[str] = []
    at = start = 0

    def close() -> Iterator[tuple[str, str]]:
        selectors, holds, own = open_.pop()
        if selectors and holds:
            yield selectors, ";".join([*own, "".join(parts)])

    while m := _STOP.search(css, at):
        parts.append(css[start : m.start()])
        at = start = m.end()
        c = m[0]
        if c in _STRING:
            at = start = _STRING[c].match(css, at).end()
            continue
        before = "".join(parts).strip()
        if c == "{":
            holds = not open_ or (open_[-1][1] and not open_[-1][0])
            if at_rule := _AT.match(before):
                name, rest = at_rule[1].lower(), at_rule[2].strip()
                shown = (name == "media" and on_screen(rest)) or name == "layer" or (name == "supports" and not rest.lower().startswith("not"))
                open_.append(("", holds and shown, []))
            else:
                open_.append((before or "?", holds, []))
        elif c == "}" and open_:
            yield from close()
        elif c == ";" and open_:
            open_[-1][2].append(before)
        parts = []
    parts.append(css[start:])
    while open_:
        yield from close()
        parts = []


def style_rules(styles: list[str]) -> Rules:
    """Display and visibility by simple selector (tag, .class, #id)."""
    out: Rules = {}
    place = 0
    for css in styles:
        for before, body in css_rules(re.sub(r"/\*.*?(?:\*/|$)", "", css, flags=re.S).replace("<!--", "").replace("-->", "")):
            declared = [(m[1].lower(), m[2].lower(), bool(m[3])) for m in _DECLARED.finditer(body)]
            if not declared:
                continue
            for selector in (x.strip() for x in before.split(",")):
                if _SIMPLE.fullmatch(selector):
                    place += 1
                    # Names of elements are in lower case here.
                    own = out.setdefault(selector if selector[0] in ".#" else selector.lower(), {})
                    for what, value, important in declared:
                        if what not in own or important >= own[what][0]:
                            own[what] = (important, place, value)
    return out


def styled(node: Node, what: str, rules: Rules) -> str:
    """The value of display or visibility that wins; empty if none is given."""
    a, best = node.attrs, (False, -1, 0, "")
    if "style" in a:
        for m in _DECLARED.finditer(a["style"]):
            if m[1].lower() == what:
                best = max(best, (bool(m[3]), 3, m.start(), m[2].lower()))
    if rules:
        for rank, names in ((0, [node.tag]), (1, [f".{c}" for c in a.get("class", "").split()]), (2, [f"#{a['id']}"] if "id" in a else [])):
            for name in names:
                if what in rules.get(name, ()):
                    important, place, value = rules[name][what]
                    best = max(best, (important, rank, place, value))
    return best[3]


def seen(node: Node, rules: Rules, shown: bool) -> bool:
    value = styled(node, "visibility", rules) if rules or "style" in node.attrs else ""
    return False if value in ("hidden", "collapse") else True if value in ("visible", "initial") else shown


def gone(node: Node, rules: Rules) -> bool:
    """Not laid out at all."""
    a = node.attrs
    if node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return True
    return bool(rules or "style" in a) and styled(node, "display", rules) == "none"


class Page:
    """Lines as they are laid out."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blanks = 0
        self.indent = 0
        self.mark = ""
        self.gap = False

    def word(self, s: str) -> None:
        s = _BLANK.sub(" ", s)
        if s[0] == " ":
            self.gap = bool(self.now)
            s = s[1:]
        if not s:
            return
        if self.gap:
            self.now.append(" ")
        self.gap = s[-1] == " "
        self.now.append(s[:-1] if self.gap else s)

    def end_line(self, blanks: int = 0) -> None:
        if self.now:
            self.put("".join(self.now))
        self.now, self.gap = [], False
        self.blanks = max(self.blanks, blanks)

    def put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.blanks
        self.blanks = 0
        lead = " " * max(0, self.indent - len(self.mark)) + self.mark
        self.lines.append((lead + line).rstrip(" "))
        self.mark = ""


def spans(node: Node, name: str, least: int, most: int) -> int:
    n = node.attrs.get(name, "1").strip()
    return min(max(int(n), least), most) if n.isdecimal() and len(n) < 6 else 1


#: Lines of tables that are laid out already, by their nodes.
Laid = dict[int, list[str]]


def cells(table: Node, rules: Rules, laid: Laid, shown: bool) -> tuple[list[str], list[list[tuple[int, str]]]]:
    """Texts of captions, and rows of (columns spanned, text); where a cell of an earlier row reaches down, the text is empty."""
    captions, rows, todo = [], [], [(n, shown, False, table) for n in reversed(table.below)]
    group, taken = table, {}  # taken: by column, the first row that the cell above leaves free
    while todo:
        n, shown, folded, of = todo.pop()
        if isinstance(n, str):
            if n.strip() and shown:
                captions.append(_BLANK.sub(" ", n).strip())
            continue
        if gone(n, rules):
            continue
        if n.tag in ("tbody", "thead", "tfoot", "tr"):
            folded = folded or styled(n, "visibility", rules) == "collapse"
            shown = seen(n, rules, shown)
        if n.tag in ("tbody", "thead", "tfoot"):
            todo += [(x, shown, folded, n) for x in reversed(n.below)]
        elif n.tag == "tr":
            if of is not group:
                group, taken = of, {}
            row, at, number = [], 0, len(rows)
            for c in n.below:
                if isinstance(c, str):
                    captions += [_BLANK.sub(" ", c).strip()] if c.strip() and shown else []
                elif not gone(c, rules):
                    free = at
                    while taken.get(free, 0) > number:
                        free += 1
                    if free > at:
                        row.append((free - at, ""))
                    across, down = spans(c, "colspan", 1, 1000), spans(c, "rowspan", 0, 65534)
                    row.append((across, "" if folded else " ".join(" ".join(render(c, rules, laid, shown)).split())))
                    at = free + across
                    if down != 1:
                        taken |= dict.fromkeys(range(free, at), number + down if down else float("inf"))
            rows.append(row)
        elif n.tag not in ("col", "colgroup"):
            captions += render(n, rules, laid, shown)
    return captions, rows


def table_lines(rows: list[list[tuple[int, str]]]) -> list[str]:
    """Columns as wide as their widest cell that spans one, two blanks between them."""
    width: dict[int, int] = {}
    for row in rows:
        at = 0
        for span, s in row:
            if span == 1:
                width[at] = max(width.get(at, 0), len(s))
            at += span
    for row in rows:
        at = 0
        for span, s in row:  # what a cell over several columns lacks goes to the last of them
            room = sum(width.get(at + k, 0) for k in range(span)) + 2 * (span - 1)
            if span > 1 and len(s) > room:
                width[at + span - 1] = width.get(at + span - 1, 0) + len(s) - room
            at += span
    out = []
    for row in rows:
        line, at, place = "", 0, 0
        for span, s in row:
            line = line.ljust(place) + s
            place = max(place + sum(width.get(at + k, 0) + 2 for k in range(span)), len(line) + 2)
            at += span
        if line.strip():
            out.append(line.rstrip())
    return out


def render(root: Node, rules: Rules, laid: Laid, shown: bool = True) -> list[str]:
    out = Page()
    # (node, seen, preformatted, list counter) or a function to call when the element ends
    todo: list = [(root, shown, False, None)]
    while todo:
        item = todo.pop()
        if callable(item):
            item()
            continue
        node, shown, pre, counter = item
        if isinstance(node, str):
            if not shown:
                continue
            if pre:
                first, *rest = node.replace("\r\n", "\n").replace("\r", "\n").split("\n")
                if first:
                    out.now.append(first)
                for line in rest:
                    out.put("".join(out.now))
                    out.now = [line] if line else []
            else:
                out.word(node) if node else None
            continue
        tag = node.tag
        if gone(node, rules) and node is not root:
            continue
        shown = seen(node, rules, shown)
        if tag == "br":
            if out.now:
                out.end_line()
            elif shown and out.lines:
                out.blanks = max(out.blanks, 1)
            continue
        if tag == "hr":
            out.end_line(1)
            continue
        if tag == "input" and shown and node.attrs.get("value", "").strip() and node.attrs.get("type", "").strip().lower() not in UNSHOWN_INPUTS:
            out.word(f" {node.attrs['value']} ")
        if tag in VOID:
            continue
        blanks = 1 if tag in SPACED else 0
        if tag in ("ul", "ol", "menu", "dir") and counter is not None:
            blanks = 0  # a list within a list
        block = tag in BLOCK and node is not root
        if block:
            out.end_line(blanks)
        if tag == "table":
            for line in laid[id(node)]:
                out.put(line)
            out.end_line(1)
            continue
        below = node.below
        if tag == "details" and "open" not in node.attrs:
            below = [n for n in below if isinstance(n, Node) and n.tag == "summary"][:1]
        if tag == "select":
            options = [o for n in below if isinstance(n, Node) for o in ([n] if n.tag == "option" else [x for x in n.below if isinstance(x, Node) and x.tag == "option"])]
            below = [o for o in options if "selected" in o.attrs][:1] or options[:1]
        inner = counter if tag != "li" else [None]
        if tag in ("ul", "menu", "dir"):
            inner = [None]
        elif tag == "ol":
            start = node.attrs.get("start", "1").strip()
            inner = [int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1]
        indent = out.indent
        if tag == "li" and shown:
            value = node.attrs.get("value", "").strip()
            if counter and counter[0] is not None:
                if re.fullmatch(r"-?\d{1,9}", value):
                    counter[0] = int(value)
                mark = f"{counter[0]}. "
                counter[0] += 1
            else:
                mark = "- "
            out.indent, out.mark = indent + len(mark), mark
        elif tag in ("dd", "blockquote"):
            out.indent = indent + 2

        def leave(block=block, blanks=blanks, indent=indent, tag=tag):
            if block:
                out.end_line(blanks)
            if tag == "li" and out.mark:
                out.mark = ""  # an empty item shows nothing
            out.indent = indent

        todo.append(leave)
        own_pre = pre or tag in ("pre", "textarea", "xmp", "listing", "plaintext")
        if own_pre and not pre and below and isinstance(below[0], str) and below[0].startswith("\n"):
            below = [below[0][1:], *below[1:]]
        todo += [(n, shown, own_pre, inner) for n in reversed(below)]
    out.end_line()
    return out.lines


def tables(root: Node, rules: Rules) -> list[tuple[Node, bool]]:
    """All tables that are laid out, outer ones first, and whether they are visible."""
    out, todo = [], [(root, True)]
    while todo:
        node, shown = todo.pop()
        if node is not root and gone(node, rules):
            continue
        shown = seen(node, rules, shown)
        if node.tag == "table":
            out.append((node, shown))
        todo += [(n, shown) for n in node.below if not isinstance(n, str)]
    return out


def extract(page: str | None) -> str:
    """The visible text of one page."""
    if not page:
        return ""
    root, styles = parse(page.replace("\0", "�"))
    rules, laid = style_rules(styles), {}
    for table, shown in reversed(tables(root, rules)):
        captions, rows = cells(table, rules, laid, shown)
        laid[id(table)] = captions + table_lines(rows)
    return "\n".join(render(root, rules, laid)).replace("\xa0", " ").strip("\n")


def texts(pages: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """The key and ``text`` for every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([extract(x) for x in batch.column(column).to_pylist()], pa.string())], [key, "text"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, column).mapInArrow(run, f"{key} {kind}, text string")


def op6_html_text(spark, sf_dir):
    return texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
