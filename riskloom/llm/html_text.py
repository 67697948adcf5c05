"""Layout-aware text of HTML pages: a tree builder with implied tags, visibility rules and a renderer.

All visible text comes out, none is guessed away: blocks start lines, paragraphs, headings, lists and tables stand
apart, list items keep bullets or numbers and indentation, table cells line up in columns. Elements render when they
close, into their parent, so nesting needs no recursion. Reruns agree; text outside any tag is text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import arrow_rows, pieces, ship

# Element names of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
UNSEEN = {"head", "script", "style", "title", "template", "noscript", "iframe", "noembed", "noframes", "canvas", "audio", "video", "datalist"}
# In drawings and formulas: what only defines or describes; of a drawing only its texts show.
DRAWN_UNSEEN = {"defs", "desc", "metadata", "symbol", "clippath", "mask", "marker", "pattern", "annotation", "annotation-xml"}
APART = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "blockquote", "pre", "figure", "table", "fieldset", "menu", "dir", "listing", "xmp", "hr"}
LINE = {"html", "body", "div", "section", "article", "aside", "header", "footer", "nav", "main", "address", "center", "details", "summary", "dialog", "dd", "dt", "figcaption", "form", "hgroup", "legend", "li", "option", "optgroup", "select", "search", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"} | APART
CLOSES_P = (LINE - {"html", "body", "li", "dd", "dt", "option", "optgroup", "select", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}) | {"li", "dd", "dt"}
# An opening tag of the key implies the end of an open element of the first set, up to one of the second.
_CELLS, _ROWS = {"td", "th"}, {"tbody", "thead", "tfoot"}
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": (_CELLS, {"tr", "table"}),
    "th": (_CELLS, {"tr", "table"}),
    "tr": ({"tr"} | _CELLS | {"caption"}, {"table"} | _ROWS),
    "tbody": (_ROWS | {"tr", "caption"} | _CELLS, {"table"}),
    "thead": (_ROWS | {"tr", "caption"} | _CELLS, {"table"}),
    "tfoot": (_ROWS | {"tr", "caption"} | _CELLS, {"table"}),
    "body": ({"head"}, {"html"}),
}

# A quote opens a string only where a value begins; elsewhere it is a letter of a name or value.
_VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>]*"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[\s/]+|=?[^\s/>=]+(?:\s*=\s*(?:{_VALUE}))?|=)*)>?|[^<]+|<", re.S)
_ATTR = re.compile(rf"(=?[^\s/>=]+)(?:\s*=\s*({_VALUE}))?")
_DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"[.#]?[\w-]+")
_CSS = re.compile(r"/\*.*?(?:\*/|\Z)|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[{};]|[^{};\"'/]+|.", re.S)
_FEATURE = re.compile(r"\(\s*(?:(min-|max-)?([a-z-]+)\s*(?:(:|[<>]=?|=)\s*([^()<>=]+?)\s*)?|([0-9.]+[a-z]*)\s*([<>]=?)\s*(width|height)\s*(?:([<>]=?)\s*([0-9.]+[a-z]*)\s*)?)\)")
# The screen that @media rules are read for, and what else they may ask of it.
SCREEN = {"width": 1280.0, "height": 800.0}
TRAITS = {"orientation": "landscape", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "prefers-contrast": "no-preference", "scripting": "enabled", "update": "fast"}
_SPACE = re.compile(r"[ \t\n\r\f]+")
DEEPEST = 256
# The most columns and rows that a cell may span.
WIDEST, TALLEST = 1000, 65534


def _hides(name: str, value: str) -> bool | None:
    """Whether a value of display or visibility hides; None where it says what the parent says."""
    if name == "visibility" and value.lower() in ("inherit", "unset", "revert", "revert-layer"):
        return None
    return value.lower() in ("none", "hidden", "collapse")


def attributes(raw: str) -> dict[str, str]:
    """What stands between a tag's name and its end; of repeated names the first holds."""
    out: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] or ""
        out.setdefault(m[1].lower(), value[1:-1] if len(value) > 1 and value[0] in "\"'" and value[0] == value[-1] else value)
    return out


def _pixels(value: str) -> float | None:
    m = re.fullmatch(r"([0-9.]+)(px|em|rem|)", value.strip())
    try:
        return float(m[1]) * (16 if m[2] in ("em", "rem") else 1) if m else None
    except ValueError:
        return None


def _compare(a: float | None, sign: str, b: float | None) -> bool:
    if a is None or b is None:
        return False
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}.get(sign, a == b)


def _feature(m: re.Match) -> bool:
    if m[7]:
        own = SCREEN[m[7]]
        return _compare(_pixels(m[5]), m[6], own) and (not m[8] or _compare(own, m[8], _pixels(m[9])))
    name, value = m[2], m[4]
    if name.removeprefix("device-") in SCREEN:
        sign = {"min-": ">=", "max-": "<="}.get(m[1], m[3] if m[3] != ":" else "=")
        return value is None or _compare(SCREEN[name.removeprefix("device-")], sign, _pixels(value))
    return name == "color" or (name in TRAITS and (value is None and TRAITS[name] != "no-preference" or value == TRAITS[name]))


def on_screen(media: str) -> bool:
    """Whether a media query list holds for ``SCREEN``; what isn't understood doesn't."""
    for query in re.sub(r"/\*.*?\*/", " ", media.lower(), flags=re.S).split(","):
        query = query.strip()
        turned = re.match(r"not\b", query)
        body = re.sub(r"^(?:not|only)\b", "", query).strip()
        parts = re.split(r"\s+or\s+", body)
        holds = []
        for part in parts:
            rest, ok = part, True
            for m in _FEATURE.finditer(part):
                ok = ok and _feature(m)
            rest = re.sub(r"\band\b", " ", _FEATURE.sub(" ", rest)).split()
            holds.append((ok and all(t in ("screen", "all") for t in rest), all(re.fullmatch(r"[a-z-]+", t) for t in rest)))
        out = any(ok for ok, _ in holds)
        known = all(k for _, k in holds)
        if known and out != bool(turned):
            return True
    return False


def style_rules(sheet: str, order: int) -> Iterator[tuple[str, str, tuple, bool | None]]:
    """selector, property, weight (important, specificity, order) and whether it hides, of the rules for a screen."""
    stack, text = [True], ""
    opened: list[str] = []
    for m in _CSS.finditer(sheet):
        part = m[0]
        if part.startswith("/*"):
            continue
        if part == "{":
            head, text = text.strip(), ""
            name = re.match(r"@([\w-]*)", head)
            if name is None:
                inner = stack[-1]
            elif name[1].lower() == "media":
                inner = stack[-1] and on_screen(head[6:])
            else:
                inner = stack[-1] and (name[1].lower() in ("layer", "scope") or (name[1].lower() == "supports" and not re.match(r"@supports\s+not\b", head, re.I)))
            stack.append(inner)
            opened.append(head)
        elif part == "}":
            if opened:
                head, on = opened.pop(), stack.pop()
                if on and not head.startswith("@"):
                    order += 1
                    for d in _DECLARATION.finditer(text):
                        for selector in map(str.strip, head.split(",")):
                            if _SELECTOR.fullmatch(selector):
                                special = 2 if selector[0] == "#" else 1 if selector[0] == "." else 0
                                yield selector, d[1].lower(), (bool(d[3]), special, order), _hides(d[1].lower(), d[2])
            text = ""
        elif part == ";" and (not opened or opened[-1].startswith("@")):
            text = ""
        else:
            text += part


class Block:
    """An open element: finished lines, the line in the making, and what its place asks for."""

    __slots__ = ("cells", "down", "drawn", "edge", "faint", "hidden", "inline", "kind", "lines", "marker", "mute", "number", "pre", "rows", "span", "tag", "text")

    def __init__(self, tag: str, hidden: bool, pre: bool, inline: bool):
        self.tag, self.hidden, self.pre, self.inline = tag, hidden, pre, inline
        self.lines: list[str] = []
        self.text: list[str] = []
        self.edge = self.drawn = self.mute = self.faint = False
        self.rows: list | None = None
        self.cells: list | None = None
        self.number, self.marker, self.kind, self.span, self.down = 0, "", "1", 1, 1

    def end_line(self) -> None:
        line = "".join(self.text)
        self.text = []
        line = line if self.pre else _SPACE.sub(" ", line).strip(" ")
        if line or self.pre:
            self.put([line], False)

    def put(self, lines: list[str], apart: bool) -> None:
        """Whole lines, after a blank one if they or what stood before want it."""
        if lines:
            if self.lines and (apart or self.edge):
                self.lines.append("")
            self.lines.extend(lines)
            self.edge = apart


def number(value: str | None, otherwise: int) -> int:
    """A whole number of at most nine digits, or ``otherwise``."""
    return int(value) if re.fullmatch(r"\s*-?[0-9]{1,9}\s*", value or "", re.A) else otherwise


def numbered(n: int, kind: str) -> str:
    """A list's number as its type has it: digits, letters or Roman numerals."""
    out = ""
    if kind in ("a", "A") and n > 0:
        while n:
            n, letter = divmod(n - 1, 26)
            out = chr(ord(kind) + letter) + out
    elif kind in ("i", "I") and 0 < n < 4000:
        for worth, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out, n = out + sign * (n // worth), n % worth
        out = out.upper() if kind == "I" else out
    return out or str(n)


def filled(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int]]]:
    """Rows of (lines, columns, rows spanned) as (lines, columns): a cell keeps its columns in the rows it reaches into."""
    out, held = [], {}
    for row in rows:
        made, at = [], 0
        below = {c: k - 1 for c, k in held.items() if k > 1}
        for lines, span, down in row:
            while at in held:
                made.append(([], 1))
                at += 1
            made.append((lines, span))
            if down > 1:
                below |= dict.fromkeys(range(at, at + span), down - 1)
            at += span
        out.append(made)
        held = below
    return out


def aligned(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Rows of (lines, span) as lines whose cells begin in the same column; columns without a cell of their own take no room."""
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), max(map(len, lines), default=0))
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            at, parts = 0, []
            for lines, span in row:
                own = [widths[c] for c in range(at, at + span) if c in widths]
                parts.append((lines[k] if k < len(lines) else "").ljust(sum(own) + 2 * (len(own) - 1)))
                at += span
            out.append("  ".join(parts).rstrip())
    return out


class Page:
    """Builds the tree of one page and renders elements as they close."""

    def __init__(self) -> None:
        self.open = [Block("#root", False, False, False)]
        self.deep: list[tuple[str, bool, bool]] = []
        self.deep_tags: Counter[str] = Counter()
        self.rules: dict[str, dict[str, tuple[tuple, bool | None]]] = {}
        self.order = 0

    def style(self, sheet: str) -> None:
        """Of the rules for a selector and property the weightiest holds, of equal ones the last."""
        for selector, name, weight, hides in style_rules(sheet, self.order):
            self.order = weight[2]
            known = self.rules.setdefault(selector if selector[0] in ".#" else selector.lower(), {})
            if name not in known or known[name][0] <= weight:
                known[name] = weight, hides

    def gone(self, tag: str, attrs: dict[str, str]) -> tuple[bool, bool | None]:
        """Whether an element isn't displayed, and whether it is invisible (None: as its parent is).

        The hidden attribute, the rules for a tag, its classes and id, and its own style say so. What isn't displayed
        takes its children along; of what is invisible a child may be visible again.
        """
        now: dict[str, tuple[tuple, bool | None]] = {"display": ((False, -1, 0), "hidden" in attrs)}
        for name in {tag, *("." + c for c in attrs.get("class", "").split()), "#" + attrs.get("id", "")} if self.rules else ():
            for of, rule in self.rules.get(name, {}).items():
                now[of] = rule if of not in now or now[of][0] <= rule[0] else now[of]
        for d in _DECLARATION.finditer(attrs.get("style", "")):
            of, rule = d[1].lower(), ((bool(d[3]), 3, 0), _hides(d[1].lower(), d[2]))
            now[of] = rule if of not in now or now[of][0] <= rule[0] else now[of]
        return bool(now["display"][1]), now.get("visibility", (None, None))[1]

    def block(self) -> Block:
        """The nearest open element that holds lines."""
        return next(b for b in reversed(self.open) if not b.inline)

    def hidden(self) -> bool:
        return self.deep[-1][1] if self.deep else self.open[-1].hidden

    def faint(self) -> bool:
        return self.deep[-1][2] if self.deep else self.open[-1].faint

    def words(self, text: str) -> None:
        if self.hidden() or self.faint() or self.open[-1].mute:
            return
        block = self.block()
        if block.rows is not None or block.cells is not None:
            if not text.strip():
                return
        if block.pre:
            first, *rest = text.split("\n")
            block.text.append(first)
            for part in rest:
                block.end_line()
                block.text.append(part)
        else:
            block.text.append(text)

    def break_line(self) -> None:
        block = self.block()
        if block.text and block.rows is None:
            block.end_line()

    def surface(self, depth: int) -> None:
        """Close elements below the depth cap."""
        for tag, hidden, _ in reversed(self.deep[depth:]):
            self.deep_tags[tag] -= 1
            if tag in LINE and not hidden:
                self.break_line()
        del self.deep[depth:]

    def close_to(self, depth: int) -> None:
        self.surface(0)
        while len(self.open) > depth:
            self.close()

    def close(self) -> None:
        done = self.open.pop()
        if done.inline:
            return
        if done.pre and done.text == [""]:
            done.text = []
        if done.text:
            done.end_line()
        into = self.block()
        if done.hidden:
            return
        if done.tag in _CELLS and into.cells is not None:
            into.cells.append((done.lines, done.span, done.down))
            return
        if done.tag == "tr" and (table := self.table()) is not None:
            if done.lines:
                done.cells.append((done.lines, 1, 1))
            if done.cells:
                table.rows.append(done.cells)
            return
        lines = done.lines
        if done.tag == "table":
            lines = [*lines, *aligned(filled(done.rows))]
        if done.tag == "li" and lines:
            wide = " " * len(done.marker)
            lines = [(wide if done.faint else done.marker) + lines[0], *[wide + x if x else x for x in lines[1:]]]
        elif done.tag in ("dd", "blockquote"):
            lines = ["  " + x if x else x for x in lines]
        elif done.tag == "hr":
            lines = ["----"]
        if into.text:
            into.end_line()
        nested = done.tag in ("ul", "ol", "menu", "dir") and any(b.tag == "li" for b in self.open)
        into.put(lines, done.tag in APART and not nested)

    def table(self) -> Block | None:
        return next((b for b in reversed(self.open) if b.rows is not None), None)

    def imply_end(self, tags: set[str], until: set[str]) -> None:
        """Close the outermost open element of ``tags`` above the nearest of ``until``."""
        found = None
        # below the depth cap as far as above it
        low = max(len(self.deep) - DEEPEST, 0)
        for depth in range(len(self.deep) - 1, low - 1, -1):
            if self.deep[depth][0] in until:
                break
            if self.deep[depth][0] in tags:
                found = depth
        else:
            if found is None and not low:
                return self.imply_end_above(tags, until)
        if found is not None:
            self.surface(found)
        return None

    def imply_end_above(self, tags: set[str], until: set[str]) -> None:
        found = None
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag in until:
                break
            if self.open[depth].tag in tags:
                found = depth
        if found:
            self.close_to(found)

    def start(self, tag: str, raw: str) -> None:
        attrs = attributes(raw) if raw.strip(" /") else {}
        drawn = self.open[-1].drawn
        if (drawn or tag in ("svg", "math")) and raw.rstrip().endswith("/"):
            return
        if tag in CLOSES_P:
            self.imply_end({"p"}, {"table", "td", "th", "button", "caption", "object"})
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and not self.deep and self.open[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.close()
        if tag in IMPLIED:
            self.imply_end(*IMPLIED[tag])
        if tag in _CELLS and not self.deep and self.table() is not None and self.block().cells is None:
            self.start("tr", "")
        if tag == "br":
            if not self.hidden():
                block = self.block()
                if "".join(block.text).strip() or block.pre:
                    block.end_line()
                else:
                    # an empty line
                    block.text.clear()
                    block.edge = True
            return
        if tag in VOID:
            if tag == "hr" and not self.hidden() and not self.faint():
                self.open.append(Block("hr", False, False, False))
                self.close()
            elif tag == "img" and attrs.get("alt"):
                self.words(html.unescape(attrs["alt"]))
            elif tag == "input" and attrs.get("type", "").lower() in ("submit", "button", "reset") and attrs.get("value") and not self.gone(tag, attrs)[0] and not self.gone(tag, attrs)[1]:
                self.words(html.unescape(attrs["value"]))
            return
        unseen = tag in UNSEEN or (drawn and tag in DRAWN_UNSEEN) or (tag == "dialog" and "open" not in attrs)
        hides, faint = self.gone(tag, attrs)
        unseen, faint = unseen or hides, self.faint() if faint is None else faint
        if self.deep or len(self.open) >= DEEPEST:
            if tag in LINE and not self.hidden():
                self.break_line()
            self.deep.append((tag, self.hidden() or unseen, faint))
            self.deep_tags[tag] += 1
            return
        label = drawn and tag == "text"
        new = Block(tag, self.hidden() or unseen, self.open[-1].pre or tag in ("pre", "listing", "xmp", "textarea"), tag not in LINE and tag != "textarea" and not label)
        new.faint = faint
        new.drawn = tag in ("svg", "math") or (drawn and tag != "foreignobject")
        new.mute = tag == "svg" or (self.open[-1].mute and not label and tag != "foreignobject")
        if tag == "table":
            new.rows = []
        elif tag == "tr" and self.table() is not None:
            new.cells = []
        elif tag in _CELLS:
            wide, down = number(attrs.get("colspan"), 1), number(attrs.get("rowspan"), 1)
            new.span, new.down = min(max(wide, 1), WIDEST), min(down if down > 0 else TALLEST, TALLEST)
        elif tag in ("ol",):
            new.number = number(attrs.get("start"), 1) - 1
            new.kind = attrs.get("type", "1")
        elif tag == "li":
            into = next((b for b in reversed(self.open) if b.tag in ("ol", "ul", "menu", "dir")), None)
            if into is not None and into.tag == "ol":
                into.number = number(attrs.get("value"), into.number + 1)
                new.marker = f"{numbered(into.number, attrs.get('type', into.kind))}. "
            else:
                new.marker = "- "
        if not new.inline and not new.hidden:
            self.break_line()
        self.open.append(new)

    def end(self, tag: str) -> None:
        if tag == "br":
            return self.start("br", "")
        if self.deep_tags[tag]:
            depth = len(self.deep) - 1
            while self.deep[depth][0] != tag:
                depth -= 1
            return self.surface(depth)
        scope = {"table", "td", "th", "caption"} if tag not in _ROWS | _CELLS | {"table", "tr", "caption", "body", "html"} else {"table"} if tag != "table" else set()
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                return self.close_to(depth)
            if self.open[depth].tag in scope:
                return None
        return None


def tokens(source: str) -> Iterator[tuple[re.Match, str | None]]:
    """Tokens, start tags of raw elements with the text up to their end."""
    at, size, lowered, drawn = 0, len(source), None, False
    while at < size:
        m = _TOKEN.match(source, at)
        at, body = m.end(), None
        if m[2] is not None and m[2].lower() in ("svg", "math"):
            drawn = not m[1] and not m[3].rstrip().endswith("/")
        if m[2] is not None and not m[1] and (tag := m[2].lower()) in RAW and not (tag in ("title", "style", "script") and m[3].rstrip().endswith("/") and drawn):
            lowered = lowered if lowered is not None else source.lower()
            # lower-casing may change lengths for a few letters; then look in the page itself
            end = (lowered if len(lowered) == size else source).find(f"</{tag}", at)
            body, at = source[at : end if end >= 0 else size], end if end >= 0 else size
        yield m, body


def render(source: str | None) -> str:
    """The visible text of a page; empty for null or empty pages."""
    if not source:
        return ""
    page = Page()
    if re.search("<style", source, re.I):
        for m, body in tokens(source):
            if body is not None and m[2].lower() == "style":
                media = attributes(m[3]).get("media", "").strip()
                if not media or on_screen(media):
                    page.style(body)
    for m, body in tokens(source):
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                page.words(html.unescape(m[0]) if "&" in m[0] else m[0])
            elif m[0].startswith("<![CDATA["):
                page.words(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            page.end(tag)
            continue
        page.start(tag, m[3])
        if tag == "xmp":
            page.words(body)
        elif tag == "textarea":
            body = body.removeprefix("\r").removeprefix("\n")
            page.words(html.unescape(body) if "&" in body else body)
    page.close_to(1)
    root = page.open[0]
    if root.text:
        root.end_line()
    return "\n".join(root.lines)


TEXT = pa.schema([("page_id", pa.int64()), ("text", pa.string())])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id and text of every page.

    Null and empty pages give an empty text. Null ids and repeated rows each keep their row. Other columns are ignored.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            yield arrow_rows(TEXT, page_id=batch.column("page_id"), text=[render(x) for x in batch.column("html").to_pylist()])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string")
