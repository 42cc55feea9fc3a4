"""Reading of HTML pages, one at a time: a small tree of elements and the text in it.

Browsers repair broken markup; so does this, as far as the text needs it: paragraphs, list items and table parts close
implicitly, stray end tags are ignored, an unfinished page ends where it ends. Reading takes time in proportion to the
page, however deeply its elements are nested.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of these closes an open element of those, unless one of the last group lies between.
_ITEM = frozenset("ul ol menu dir table".split())
_CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), _ITEM),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_CLOSES_P = BLOCKS - frozenset("body html caption td th tr tbody thead tfoot option optgroup legend".split())
_P_SCOPE = frozenset("td th caption button table object html".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass
class Node:
    tag: str
    parent: Node | None
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    start: int = 0


def _attributes(source: str) -> dict[str, str]:
    if not source or source.isspace():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


class _Open:
    """The open elements, outermost first, and where each kind of them lies, so that nothing is looked for by climbing."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    @property
    def here(self) -> Node:
        return self.stack[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The innermost place of an open element of these tags, or -1."""
        return max((found[-1] for t in tags if (found := self.places.get(t))), default=-1)

    def cut(self, place: int) -> None:
        """Closes the element at this place and all within it."""
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def end(self, tag: str) -> None:
        found = self.places.get(tag)
        if not found:
            return
        at = found[-1]
        if at < len(self.stack) - 1 and (tag == "p" or tag not in BLOCKS) and self.last(_P_SCOPE - {tag}) > at:
            return
        self.cut(at)

    def imply(self, tag: str) -> None:
        paragraphs = self.places.get("p")
        if paragraphs and tag in _CLOSES_P and paragraphs[-1] > self.last(_P_SCOPE):
            self.cut(paragraphs[-1])
        if tag in _CLOSES:
            closed, walls = _CLOSES[tag]
            if (at := self.last(closed)) > self.last(walls):
                self.cut(at)


def parse(source: str) -> Node:
    """The tree of a page. Texts are strings among the children, with character references decoded."""
    root = Node("#root", None)
    open_, at, n = _Open(root), 0, len(source)
    find = source.find

    def text(until: int) -> None:
        if until > at:
            open_.here.children.append(html.unescape(source[at:until]))

    while at < n:
        lt = find("<", at)
        if lt < 0:
            text(n)
            break
        after = source[lt + 1 : lt + 2]
        if after == "!" or after == "?":
            text(lt)
            if source.startswith("<!--", lt):
                end = find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = find(">", lt)
                at = n if end < 0 else end + 1
            continue
        match = _TAG.match(source, lt)
        if match is None:
            if after.isalpha() or after == "/":  # an unfinished tag
                text(lt)
                end = find(">", lt)
                at = n if end < 0 else end + 1
            else:
                text(lt + 1)
                at = lt + 1
            continue
        text(lt)
        at = match.end()
        tag = match[2].lower()
        if match[1]:
            open_.end(tag)
            continue
        open_.imply(tag)
        node = Node(tag, open_.here, _attributes(match[3]), start=lt)
        open_.here.children.append(node)
        if tag in VOID or match[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(source, at)
            stop = end.start() if end else n
            if tag in ("title", "textarea"):
                node.children.append(html.unescape(source[at:stop]))
            else:
                node.children.append(source[at:stop])
            close = find(">", stop)
            at = n if close < 0 else close + 1
            continue
        open_.push(node)
    return root


def blocks(nodes: list[Node], skip) -> list[str]:
    """The texts of blocks in page order, white space turned into single spaces; subtrees for which ``skip`` holds are left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            words = " ".join("".join(run).split())
            if words:
                out.append(words)
            run.clear()

    stack: list[tuple[Node | str, bool]] = [(x, False) for x in reversed(nodes)]
    while stack:
        item, done = stack.pop()
        if isinstance(item, str):
            run.append(item)
        elif done:
            flush()
        elif item.tag == "br":
            run.append("\n")
        elif not skip(item):
            if item.tag in BLOCKS or item.tag == "#root":
                flush()
                stack.append((item, True))
            stack.extend((x, False) for x in reversed(item.children))
    flush()
    return out


def walk(root: Node):
    """All elements below and including ``root``, parents first, in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(x for x in reversed(node.children) if not isinstance(x, str))
