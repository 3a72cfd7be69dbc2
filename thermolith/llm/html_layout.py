"""HTML to text by layout: a tree builder with implied tags, visibility rules, and a
renderer that keeps block spacing, lists and aligned table cells.

The builder reads tags with one pass over the page, closes what HTML lets authors leave
open (paragraphs, list items, rows, cells, options), opens what they may leave out
(table bodies and rows), and takes end tags without a start as nothing. Hidden are:
elements that no browser shows (script, style, head and the like), closed dialogs, hidden
inputs, and what the cascade hides: ``hidden``, the style of the element, and the rules of
the page's style sheets that apply to a screen, for selectors of tags, classes and ids, compound or by
ancestors (``div.x``, ``ul .y``, ``nav > a``). ``display:none`` hides all inside;
``visibility`` is inherited and may be turned back on by a child. Other selectors
(attributes, pseudo-classes, siblings) hide nothing.

Builder and renderer hold their open elements in lists of their own, so depth costs no
recursion, and neither looks back over the page or over what is open: time goes with the
length of page and text.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"[a-zA-Z][^\s/><]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
DECLARED = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([\w-]+)[^;!]*(!\s*important)?", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
COMPOUND = re.compile(r"(?:[\w-]+|\*)?(?:[.#][\w-]+)*")

# Element names of the HTML standard by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title meta link base template noscript iframe noembed noframes object canvas audio video svg math datalist param source track area map colgroup col".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li listing main menu nav ol optgroup option p pre search section select summary table ul xmp caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl blockquote pre table figure fieldset listing xmp".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p pre search section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, up to the elements that bound the search.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset("select optgroup datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr td th caption colgroup".split()), frozenset("table".split())),
    "thead": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "caption": (frozenset("caption colgroup".split()), frozenset(["table"])),
    "a": (frozenset(["a"]), frozenset("table td th li p div body".split())),
}
SCOPE = frozenset("table td th caption html template object".split())
#: The screen's width in pixels, for media queries.
WIDE = 1280
#: A table's columns are as wide as their widest cells while that takes so many times the table's own text and a
#: little more; where it would take more (one very wide cell over very many rows), columns count as WIDEST at most
#: for the alignment; and if that takes four times as much still (very many columns), cells only follow each other. No text is lost either way.
PADDING, LITTLE, WIDEST = 16, 1 << 14, 60
#: Indents inside each other stop moving their lines to the right at so many characters, and so do tables inside
#: tables at DEEPEST: what is nested deeper begins at the same place. No text is lost.
INDENTED, DEEPEST = 80, 320


@dataclass(slots=True)
class Node:
    name: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'")) if value else "")
    return out


class Open(list):
    """The open elements, outermost first, and where each name is among them."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self))
        self.append(node)

    def cut(self, i: int) -> None:
        """Ends all from the i-th on."""
        while len(self) > i:
            self.places[self.pop().name].pop()

    def nearest(self, names) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names: frozenset, bounds: frozenset) -> None:
        """Ends the outermost open element of ``names`` that lies inside the nearest one of ``bounds``."""
        inside = [n for n in names if self.places.get(n)]
        if inside:
            bound = self.nearest(bounds)
            first = [self.places[n][k] for n in inside if (k := bisect.bisect_right(self.places[n], bound)) < len(self.places[n])]
            if first:
                self.cut(min(first))

    def close_one(self, name: str) -> None:
        """Ends the nearest open element of this name, unless a table cell or table lies between."""
        at = self.nearest((name,))
        walls = ("table",) if name in TABLE_PARTS else SCOPE | {"table"}
        if at and self.nearest(w for w in walls if w != name) < at:
            self.cut(at)


TABLE_PARTS = frozenset("table tr td th thead tbody tfoot caption".split())
BODIES = frozenset("thead tbody tfoot".split())


def tokens(page: str):
    """(kind, name, rest) of the page in order: ``text``, ``start`` (rest: the attributes' text) or
    ``end``. After a start tag of RAW the text up to its end tag comes as one ``raw``.

    Quotes of a tag that never end are no quotes, and from there on none of the page's tags has any.
    """
    at, size, quoted, last = 0, len(page), True, page.rfind(">")
    bang: int | None = 0  # the next place of the rarer end of a comment, None if there is none left
    while at < size:
        begin = page.find("<", at)
        if begin < 0 or begin > last:  # no tag ends any more; a comment goes on to the end
            yield "text", page[at:].partition("<!--")[0], ""
            return
        if begin > at:
            yield "text", page[at:begin], ""
        if page.startswith("<!--", begin):
            if bang is not None and bang < begin + 4:
                bang = found if (found := page.find("--!>", begin + 4)) >= 0 else None
            end = found if (found := page.find("-->", begin + 2)) >= 0 else size
            at = bang + 4 if bang is not None and bang < end else end + 3
            continue
        closing = page.startswith("/", begin + 1)
        m = NAME.match(page, begin + 1 + closing)
        if not m:
            if begin + 1 < size and page[begin + 1] in "!?/":
                at = page.find(">", begin) + 1
            else:
                yield "text", "<", ""
                at = begin + 1
            continue
        end = m.end()
        while quoted:  # to the first > outside of quotes
            stop = STOP.search(page, end)
            if stop is None or stop[0] == ">":
                end = stop.start() if stop else -1
                break
            end = page.find(stop[0], stop.end()) + 1
            if not end:
                quoted = False
        if not quoted:
            end = page.find(">", m.end())
        if end < 0:  # all that is left is quotes
            quoted, end = False, page.find(">", m.end())
        name = m[0].lower()
        yield ("end" if closing else "start"), name, page[m.end() : end]
        at = end + 1
        if not closing and name in RAW:
            m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
            yield "raw", name, page[at : m.start() if m else size]
            at = page.find(">", m.end()) + 1 if m and m.end() <= last else size


def build(page: str) -> tuple[Node, str]:
    """The tree of a page, and the text of its style sheets."""
    root = Node("html", {})
    stack, styles = Open(root), []

    def start(name: str, attrs: dict[str, str]) -> None:
        node = Node(name, attrs)
        stack[-1].children.append(node)
        stack.push(node)

    for kind, name, rest in tokens(page):
        if kind == "text":
            text = html.unescape(name) if "&" in name else name
            if stack[-1].name == "head" and not text.isspace():
                stack.cut(len(stack) - 1)
            stack[-1].children.append(text)
        elif kind == "raw":
            node = stack[-1]
            if name == "style":
                styles.append(f"@media {node.attrs['media']} {{{rest}}}" if node.attrs.get("media") else rest)
            elif name in ("textarea", "xmp"):
                node.children.append(html.unescape(rest) if name == "textarea" else rest)
            stack.cut(len(stack) - 1)
        elif kind == "end":
            if name == "br":
                start("br", {})
                stack.cut(len(stack) - 1)
            elif name in HEADINGS:
                stack.close(HEADINGS, SCOPE)
            elif name == "p":
                stack.close(frozenset(["p"]), SCOPE)
            elif name not in ("html", "body"):
                stack.close_one(name)
        else:
            attrs = attributes(rest) if "=" in rest or rest.strip(" /\n\t") else {}
            if name in ("html", "body"):
                if name == "body" and stack[-1].name == "head":
                    stack.cut(len(stack) - 1)
                root.attrs = {**attrs, **root.attrs}
                continue
            if stack[-1].name == "head" and name not in HIDDEN:
                stack.cut(len(stack) - 1)
            if name in CLOSES_P:
                stack.close(frozenset(["p"]), SCOPE | {"button"})
            if name in HEADINGS and stack[-1].name in HEADINGS:
                stack.cut(len(stack) - 1)
            if name in CLOSES:
                stack.close(*CLOSES[name])
            if name in ("td", "th", "tr") and stack.places.get("table"):
                if stack[-1].name == "table":
                    start("tbody", {})
                if name != "tr" and stack[-1].name in BODIES:
                    start("tr", {})
            start(name, attrs)
            if name in VOID:
                stack.cut(len(stack) - 1)
    return root, "\n".join(styles)


def on_screen(query: str) -> bool:
    """Whether a list of media queries holds on a screen WIDE pixels wide. Features other than the width count as not met."""
    def holds(q: str) -> bool:
        turned, kind, features = re.fullmatch(r"(?:(not|only)\s+)?([a-z][\w-]*)?\s*(.*)", q, re.S).groups()
        met = kind in (None, "all", "screen") and "not" not in features.split("(")[0].split()
        for f in re.findall(r"\(([^()]*)\)", features) if met else ():
            m = re.fullmatch(r"\s*(min|max)-width\s*:\s*([\d.]+)\s*(px|em|rem)\s*", f)
            width = float(m[2]) * (1 if m[3] == "px" else 16) if m and m[2].count(".") < 2 and m[2] != "." else None
            met = met and width is not None and (width <= WIDE if m[1] == "min" else width >= WIDE)
        return not met if turned == "not" else met

    return not query.strip() or any(holds(q.strip()) for q in query.lower().split(","))


def declared(body: str) -> dict[str, tuple[bool, str]]:
    """Of ``display`` and ``visibility``: whether it is important, and the value."""
    out: dict[str, tuple[bool, str]] = {}
    for name, value, important in DECLARED.findall(body):
        name, now = name.lower(), (bool(important), value.lower())
        if now[0] >= out.get(name, now)[0]:
            out[name] = now
    return out


def style_rules(styles: str):
    """(selector, declared, place) of each rule that applies to a screen, in order."""
    css = re.sub(r"/\*.*?(?:\*/|\Z)", "", styles, flags=re.S)
    stack: list[tuple[str, bool]] = []  # selectors ("" for an at-rule), whether it applies
    begin, bodies = 0, []
    for place, m in enumerate(re.finditer(r""""[^"\n]*"|'[^'\n]*'|[{};]|\Z""", css)):
        mark = m[0]
        if mark and mark not in "{};":
            continue
        part, applies = css[begin : m.start()].strip(), not stack or stack[-1][1]
        begin = m.end()
        if mark == "{":
            if part.startswith("@"):
                name, _, rest = part[1:].partition(" ") if "(" not in part.split(" ")[0] else (part[1 : part.index("(")], "", part[part.index("(") :])
                stack.append(("", applies and (name.lower() in ("layer", "supports") and not rest.lower().startswith("not") or name.lower() == "media" and on_screen(rest))))
            else:
                nested = bool(stack and stack[-1][0])
                stack.append((part or "?", applies and not nested))
                bodies = bodies if nested else []
            continue
        if stack and stack[-1][0] and stack[-1][1]:
            bodies.append(part)
        while stack and mark != ";":
            selectors, applies = stack.pop()
            if selectors and applies and (found := declared(";".join(bodies))):
                for one in selectors.split(","):
                    yield one.strip(), found, place
            if mark:
                break


class Rules:
    """The rules of a page that set display or visibility, as one automaton over the path from the root.

    A selector of compounds c1 c2 ... ck is a run of k bits; bit i of an element is set if
    ci fits it and the compounds before fit ancestors of it in order. A compound that must be
    a child's is one whose predecessor has to be the parent. An element's bits follow from
    its parent's and from all its ancestors' in a few operations on whole masks.
    """

    def __init__(self, styles: str):
        selectors: dict[str, dict[str, tuple]] = {}
        for text, found, place in style_rules(styles):
            parts = re.sub(r"\s*>\s*", " >", text).split()
            if not parts or not all(COMPOUND.fullmatch(p.lstrip(">")) and p.lstrip(">") for p in parts) or parts[0][0] == ">":
                continue
            weight = (text.count("#"), text.count("."), sum(p.lstrip(">")[0] not in ".#*" for p in parts))
            own = selectors.setdefault(" ".join(parts), {})
            for prop, (important, value) in found.items():
                now = (important, *weight, place, value)
                own[prop] = max(own.get(prop, now), now)
        self.any = any(v[-1] in ("none", "hidden", "collapse") for own in selectors.values() for v in own.values())
        self.first = self.child = 0  # bits of first compounds, and of those that must be a child's
        self.last: dict[int, dict[str, tuple]] = {}  # bit of a last compound: what its rule sets
        uses: Counter = Counter()
        compounds: dict[frozenset, int] = defaultdict(int)  # the bits of equal compounds
        bit = 0
        for text, own in selectors.items() if self.any else ():
            parts = text.split()
            self.first |= 1 << bit
            for p in parts:
                if p[0] == ">":
                    self.child |= 1 << bit
                tag, *rest = re.findall(r"^[\w-]+|\*|[.#][\w-]+", p.lstrip(">"))
                simple = frozenset([tag.lower() if tag[0] not in ".#*" else tag, *rest])
                if simple not in compounds:
                    uses.update(simple)
                compounds[simple] |= 1 << bit
                bit += 1
            self.last[bit - 1] = own
        self.ends = sum(1 << b for b in self.last)
        self.by: dict[str, list[tuple[frozenset, int]]] = defaultdict(list)  # by the rarest part of a compound
        for simple, mask in compounds.items():
            self.by[min(simple, key=lambda x: (uses[x], x))].append((simple, mask))

    def bits(self, node: Node, parent: int, above: int) -> int:
        """Bits of an element, from its parent's and those that any ancestor has."""
        own = {node.name, "*", *("." + c for c in node.attrs.get("class", "").split())}
        if node.attrs.get("id"):
            own.add("#" + node.attrs["id"].strip())
        fits = 0
        for name in own & self.by.keys():
            for simple, mask in self.by[name]:
                if simple <= own:
                    fits |= mask
        return fits & (self.first | ((above << 1) & ~self.child & ~self.first) | ((parent << 1) & self.child))

    def set_by(self, bits: int) -> list[dict[str, tuple]]:
        bits, out = bits & self.ends, []
        while bits:
            b = bits & -bits
            out.append(self.last[b.bit_length() - 1])
            bits ^= b
        return out


def cascade(node: Node, found: list[dict[str, tuple]]) -> tuple[bool, str | None]:
    """(whether it is displayed, the visibility set for it): the rule that holds is the important
    one, else that of the style, of the more specific selector, or the later one."""
    a = node.attrs
    if node.name in HIDDEN or (node.name == "dialog" and "open" not in a) or (node.name == "input" and a.get("type", "").lower() == "hidden"):
        return False, None
    held: dict[str, tuple] = {"display": (False, -1, 0, 0, 0, "none")} if "hidden" in a else {}
    for own in found:
        for prop, now in own.items():
            held[prop] = max(held.get(prop, now), now)
    if a.get("style"):
        for prop, (important, value) in declared(a["style"]).items():
            now = (important, 1 << 30, 0, 0, 0, value)
            held[prop] = max(held.get(prop, now), now)
    return held.get("display", ("",))[-1] != "none", held["visibility"][-1] if "visibility" in held else None


class Lines:
    """Lines of text, some of them by reference: a cell's lines stand in their table's as one part, moved to the right, so that
    tables inside tables copy nothing. The last line of a part isn't empty."""

    __slots__ = ("parts", "n", "width", "chars", "lead")

    def __init__(self):
        self.parts: list[str | tuple[int, Lines, int]] = []  # a line, or how far to the right, whose lines, and how many of them to leave out
        self.n = self.width = self.chars = self.lead = 0  # lines, longest one, characters of text and ends of lines, furthest to the right by padding

    def add(self, line: str, own: int = 1, lead: int = 0) -> None:
        """``own``: what it counts as text, ``lead``: the padding before it."""
        self.parts.append(line)
        self.n += 1
        self.width = max(self.width, len(line))
        self.chars += own
        self.lead = max(self.lead, lead)

    def refer(self, right: int, lines: Lines, skip: int = 0) -> None:
        if lines.n <= skip:
            return
        right = max(0, min(right, DEEPEST - lines.lead))
        if not skip and len(lines.parts) == 1 and not isinstance(lines.parts[0], str):  # a reference to a reference
            more, lines_in, skip_in = lines.parts[0]
            self.parts.append((right + more, lines_in, skip_in))
        else:
            self.parts.append((right, lines, skip))
        self.n += lines.n - skip
        self.width = max(self.width, right + lines.width)
        self.lead = max(self.lead, right + lines.lead)

    def pop(self) -> None:
        """Takes an empty line off the end."""
        self.parts.pop()
        self.n -= 1

    def __iter__(self):
        todo: list[tuple] = [(0, iter(self.parts), 0)]  # how far to the right, what is left, how many lines to leave out
        while todo:
            right, parts, skip = todo.pop()
            for part in parts:
                if not isinstance(part, str):
                    more, lines, without = part
                    if skip >= lines.n - without:
                        skip -= lines.n - without
                        continue
                    todo += [(right, parts, 0), (right + more, iter(lines.parts), without + skip)]
                    break
                if skip:
                    skip -= 1
                else:
                    yield " " * right + part if part and right else part

    def first(self, n: int) -> list[str]:
        return list(itertools.islice(self, n))


class Canvas:
    """Lines of text; collapses white space and asked-for blank lines. Inside an indent, lines
    begin with its pad, the first of them with its head; the prefixes are only joined where a line has text."""

    def __init__(self):
        self.lines = Lines()
        self.line: list[str] = []
        self.gap = False  # a space is due before the next text
        self.indents: list[tuple] = []  # head, width of the pads up to this one, parts before
        self.base = self.unused = 0  # parts before the innermost indent; the outermost indents up to this one have used their heads

    def text(self, s: str) -> None:
        parts = SPACE.split(s)
        if len(parts) > 1 and parts[0] == "" and self.line:
            self.gap = True
        words = [p for p in parts if p]
        if words:
            if self.gap and self.line:
                self.line.append(" ")
            self.line.append(" ".join(words))
            self.gap = parts[-1] == ""
        elif s:
            self.gap = self.gap or bool(self.line)

    def exact(self, s: str) -> None:
        first, *rest = s.split("\n")
        self.line.append(first)
        for x in rest:
            self.end_line()
            self.line.append(x)
        self.gap = False

    def prefix(self) -> tuple[str, int]:
        """What a line begins with, and how much of that is padding; all heads are used by it."""
        pad = self.indents[self.unused - 1][1] if self.unused else 0
        heads = "".join([head for head, *_ in self.indents[self.unused :]])
        self.unused = len(self.indents)
        return " " * pad + heads, pad

    def put(self, text: str, bare: bool = False, counted: bool = False) -> None:
        """A line; ``bare``: even if it is empty, for its head; ``counted``: its text is counted already."""
        pad = 0
        if (text or bare) and self.indents:
            before, pad = self.prefix()
            text = before + text
        text = text.rstrip()
        self.lines.add(text, 0 if counted else max(0, len(text) - pad) + 1, pad)

    def refer(self, right: int, lines: Lines, skip: int) -> None:
        """Lines that stand elsewhere, from the skipped ones on."""
        for line in itertools.islice(lines, skip, None) if self.unused < len(self.indents) else ():
            if self.unused == len(self.indents):
                break
            self.put(" " * right + line if line else "", counted=True)  # the first one with text has the heads
            skip += 1
        self.lines.refer(right + (self.indents[-1][1] if self.indents else 0), lines, skip)

    def end_line(self) -> None:
        self.put("".join(self.line).rstrip())
        self.line, self.gap = [], False

    def block(self, blank: bool = False) -> None:
        if self.line:
            self.end_line()
        self.gap = False
        if blank and len(self.lines.parts) > self.base and self.lines.parts[-1] != "":
            self.lines.add("")

    def indent(self, head: str, pad: str) -> None:
        self.block()
        before = self.indents[-1][1] if self.indents else 0
        self.indents.append((head, before + len(pad) if before + len(pad) <= INDENTED else before, self.base))
        self.base = len(self.lines.parts)

    def outdent(self, bare: bool = False) -> None:
        """Ends an indent and drops the blank lines at its end; ``bare``: the head stands even without a line."""
        self.block()
        self.trim()
        if bare and len(self.lines.parts) == self.base:
            self.put("", True)
        self.base = self.indents.pop()[2]
        self.unused = min(self.unused, len(self.indents))

    def trim(self) -> None:
        while len(self.lines.parts) > self.base and not self.lines.parts[-1]:
            self.lines.pop()


LISTS = frozenset("ul ol menu dir".split())
PREFORMATTED = frozenset("pre listing xmp textarea".split())


class Table:
    def __init__(self):
        self.rows: list[list[tuple[Lines, int, int]]] = []

    def row(self) -> None:
        self.rows.append([])

    def placed(self) -> list[list[tuple[int, Lines, int]]]:
        """By row the cells with the columns they begin in: the next one that no cell above reaches into.

        Such columns are intervals with the row that they end before, in order; what a cell reaches into anew is its own.
        """
        out = []
        taken = np.empty((0, 3), np.int64)  # first column, column behind, row behind
        for nth, cells in enumerate(self.rows):
            row, column, i, new, runs = [], 0, 0, [], []
            if len(taken):
                taken = taken[taken[:, 2] > nth]
                parted = np.flatnonzero(taken[1:, 0] > taken[:-1, 1])
                if len(taken):
                    runs = list(zip(taken[np.append(0, parted + 1), 0].tolist(), taken[np.append(parted, -1), 1].tolist()))
            for lines, across, down in cells:
                while i < len(runs) and runs[i][0] <= column:
                    column = max(column, runs[i][1])
                    i += 1
                row.append((column, lines, across))
                if down > 1:
                    new.append((column, column + across, nth + down))
                column += across
            out.append(row)
            if new:
                both = np.concatenate((taken, np.array(new, np.int64)))
                both = both[np.argsort(both[:, 0], kind="stable")]
                apart = (both[1:, 0] >= both[:-1, 1]).all()
                taken = both if apart else np.array(_over(taken.tolist(), new), np.int64)
        return out

    def lay(self, canvas: Canvas) -> None:
        placed = self.placed()
        width: Counter = Counter()
        for row in placed:
            for column, lines, across in row:
                if across == 1 and lines.width:
                    width[column] = max(width[column], lines.width)
        said = sum(lines.chars for row in placed for _, lines, _ in row)
        tall = sum(max((lines.n for _, lines, _ in row), default=0) for row in placed)
        if tall * sum(width.values()) > PADDING * said + LITTLE:
            width = Counter({k: min(WIDEST, v) for k, v in width.items()})
            if tall * sum(v + 2 for v in width.values()) > 4 * (PADDING * said + LITTLE):
                width.clear()
        wide = sorted(width)
        ends = list(itertools.accumulate((width[c] + 2 for c in wide), initial=0))
        start = lambda column: ends[bisect.bisect_left(wide, column)]
        for row in placed:
            if not row:
                continue
            heights = sorted(lines.n for _, lines, _ in row)
            several = heights[-2] if len(heights) > 1 else 0  # lines in which cells may stand side by side
            tops = [(start(column), lines.first(several)) for column, lines, _ in row]
            for i in range(several):
                parts, length = [], 0
                for begin, top in tops:
                    if i < len(top) and top[i]:
                        room = begin - length if begin > length or not length else 2
                        parts += [" " * room, top[i]]
                        length += room + len(top[i])
                canvas.put("".join(parts).rstrip(), counted=True)
            if heights[-1] > several:
                column, longest, _ = next(c for c in row if c[1].n == heights[-1])
                canvas.refer(start(column), longest, several)
        canvas.lines.chars += said


def _over(old: list[list[int]], new: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All intervals of ``new``, and what they leave of ``old``, in order. Those of either don't overlap each other."""
    out, i = list(new), 0
    for first, behind, row in old:
        while i < len(new) and new[i][1] <= first:
            i += 1
        k = i
        while k < len(new) and new[k][0] < behind:
            if new[k][0] > first:
                out.append((first, new[k][0], row))
            first = max(first, new[k][1])
            k += 1
        if first < behind:
            out.append((first, behind, row))
    return sorted(out)


def span(cell: Node, name: str) -> int:
    said = cell.attrs.get(name, "1").strip()
    return max(1, min(1000, int(said))) if said.isascii() and said.isdecimal() and len(said) < 6 else 1


class Renderer:
    """Walks the tree with a list of what is still to do, last first: an element puts down what ends it, then its children."""

    def __init__(self, styles: str):
        rules = Rules(styles)
        self.rules = rules if rules.any else None
        self.canvas, self.todo = Canvas(), []

    def lines(self, root: Node) -> Lines:
        self.children(root.children, (False, True, 0, 0))
        while self.todo:
            do, *args = self.todo.pop()
            do(*args)
        self.canvas.block()
        self.canvas.trim()
        return self.canvas.lines

    def children(self, nodes: list, state: tuple, handle=None) -> None:
        """``state``: preformatted, visible, bits of the parent and of all ancestors."""
        handle = handle or self.node
        self.todo += [(handle, node, state) for node in reversed(nodes)]

    def later(self, do, *args) -> None:
        self.todo.append((do, *args))

    def shown(self, node: Node, state: tuple) -> tuple | None:
        """The state inside an element, None if it isn't displayed."""
        pre, seen, parent, above = state
        found = []
        if self.rules:
            parent = self.rules.bits(node, parent, above)
            above |= parent
            found = self.rules.set_by(parent)
        displayed, visibility = cascade(node, found)
        if not displayed:
            return None
        if visibility is not None and visibility != "inherit":
            seen = visibility not in ("hidden", "collapse")
        return pre, seen, parent, above

    def text(self, text: str, state: tuple) -> None:
        if state[1]:
            self.canvas.exact(text) if state[0] else self.canvas.text(text)

    def node(self, node, state: tuple) -> None:
        if isinstance(node, str):
            self.text(node, state)
        elif (inner := self.shown(node, state)) is not None:
            self.element(node, inner)

    def element(self, node: Node, state: tuple) -> None:
        name, canvas = node.name, self.canvas
        if name == "br":
            canvas.end_line()
        elif name == "input":
            if state[1] and node.attrs.get("type", "").lower() in ("submit", "button", "reset") and node.attrs.get("value"):
                canvas.text(node.attrs["value"])
        elif name in LISTS:
            self.listing(node, state)
        elif name == "table":
            canvas.block(True)
            table = Table()
            self.later(self.lay, table)
            self.children(node.children, state, lambda n, s: self.in_table(table, n, s))
        elif name in ("blockquote", "dd"):
            canvas.block(name == "blockquote")
            canvas.indent("  ", "  ")
            self.later(self.end_indent, name == "blockquote")
            self.children(node.children, state)
        elif name in PREFORMATTED:
            canvas.block(True)
            canvas.indent("", "")
            self.later(self.end_indent, True)
            inside = node.children
            if inside and isinstance(inside[0], str) and inside[0].startswith("\n"):
                inside = [inside[0][1:], *inside[1:]]
            self.children(inside, (True, *state[1:]))
        elif name in ("td", "th"):  # a cell outside of a table's rows
            canvas.gap = True
            self.later(self.due)
            self.children(node.children, state)
        elif name in BLOCK or name in BODIES or name == "tr":
            canvas.block(name in SPACED)
            self.later(canvas.block, name in SPACED)
            self.children(node.children, state)
        else:
            self.children(node.children, state)

    def due(self) -> None:
        self.canvas.gap = True

    def end_indent(self, blank: bool, bare: bool = False) -> None:
        self.canvas.outdent(bare)
        if blank:
            self.canvas.block(True)

    def listing(self, node: Node, state: tuple) -> None:
        self.canvas.block(True)
        self.later(self.canvas.block, True)
        said = node.attrs.get("start", "1").strip()
        number = [int(said) if re.fullmatch(r"-?\d{1,9}", said) else 1]

        def item(child, state: tuple) -> None:
            if isinstance(child, str):
                self.text(child, state)
                return
            inner = self.shown(child, state)
            if inner is None:
                return
            inner = (False, *inner[1:])
            self.canvas.block()
            if child.name == "li":
                head = f"{number[0]}. " if node.name == "ol" else "* "
                number[0] += 1
                self.canvas.indent(head if inner[1] else " " * len(head), " " * len(head))
                self.later(self.end_indent, False, inner[1])
                self.children(child.children, inner)
            elif child.name in LISTS:
                self.canvas.indent("  ", "  ")
                self.later(self.end_indent, False)
                self.listing(child, inner)
            else:
                self.element(child, inner)

        self.children(node.children, state, item)

    # Tables --------------------------------------------------------------------------------

    def in_table(self, table: Table, child, state: tuple) -> None:
        if isinstance(child, str):
            if child.strip():
                table.row()
                self.cell(table, [child], state)
            return
        inner = self.shown(child, state)
        if inner is None:
            return
        if child.name in BODIES:
            self.children(child.children, inner, lambda n, s: self.in_table(table, n, s))
        elif child.name == "tr":
            table.row()
            self.children(child.children, inner, lambda n, s: self.in_row(table, n, s))
        else:
            table.row()
            self.cell(table, [child], state, empty=False)

    def in_row(self, table: Table, child, state: tuple) -> None:
        if isinstance(child, str):
            if child.strip():
                self.cell(table, [child], state)
        elif child.name not in ("td", "th"):
            if self.shown(child, state) is not None:
                self.cell(table, [child], state)
        elif (inner := self.shown(child, state)) is not None:
            self.cell(table, child.children, inner, span(child, "colspan"), span(child, "rowspan"))

    def cell(self, table: Table, nodes: list, state: tuple, across: int = 1, down: int = 1, empty: bool = True) -> None:
        outer, self.canvas = self.canvas, Canvas()
        self.later(self.end_cell, table, outer, across, down, empty)
        self.children(nodes, (False, *state[1:]))

    def end_cell(self, table: Table, outer: Canvas, across: int, down: int, empty: bool) -> None:
        self.canvas.block()
        self.canvas.trim()
        if self.canvas.lines.n or empty:
            table.rows[-1].append((self.canvas.lines, across, down))
        self.canvas = outer

    def lay(self, table: Table) -> None:
        table.lay(self.canvas)
        self.canvas.block(True)


def render(page: str | None) -> str:
    """The visible text of a page; empty for null or an empty one."""
    if not page:
        return ""
    root, styles = build(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "\ufffd"))
    out: list[str] = []
    for line in Renderer(styles).lines(root):
        if line or (out and out[-1]):
            out.append(line)
    return "\n".join(out).rstrip("\n")


def text_column(page: Column) -> Column:
    @F.pandas_udf("string")
    def of(pages: pd.Series) -> pd.Series:
        return pd.Series([render(p) for p in pages], dtype=object)

    return of(page)


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``pages`` with the visible text of each in ``out_col``.

    A null or empty page has an empty text. Pages are read whole, however long or deep; lists, quotes and tables that lie in each
    other move their lines no further to the right than INDENTED and DEEPEST characters.
    Any string gives a text: what isn't a tag is text. Repeated rows give repeated rows, an
    empty table an empty one. Other columns stay; one named ``out_col`` is replaced.
    """
    return pages.withColumn(out_col, text_column(F.col(html_col)))
