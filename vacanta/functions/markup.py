"""Small per-page helper for the one Python stage: HTML to a light tree, first match, element text."""

import re
from bisect import bisect_right
from html import unescape

from vacanta.functions.selectors import compile_selector as compile_selector
from vacanta.functions.visibility import Styles

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PARAGRAPH_ENDERS = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SELF_ENDERS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
               "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}),
               "option": ({"option"}, {"select"})}
FORMATTING = {"a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u"}
BLOCK = PARAGRAPH_ENDERS | {"body", "dd", "dt", "html", "li", "tr", "caption", "figcaption", "summary"}
HIDDEN = {
    "head", "script", "style", "title", "template", "noscript", "datalist", "meta", "link", "option", "iframe", "noembed",
    "noframes",
}
SPACES = re.compile(r"[ \t\n\r\f]+")
CELL_END = ("\t", True)
NO_ATTRS = {}
# A comment, a tag with well-quoted attributes, any other tag, or a declaration. Possessive, so that odd quotes
# cost one pass.
MARKUP = re.compile(
    r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))
    |(?P<end>/)?(?:(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
                  |(?P<loose>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)(?:>|\Z))
    |[!?/][^>]*+(?:>|\Z))""",
    re.S | re.X,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*(=)\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DECODED = {"textarea", "title"}
RAW_TEXT = {
    name: re.compile(rf"</{name}(?=[\s/>])", re.I)
    for name in ("script", "style", "iframe", "noembed", "noframes", "xmp", "textarea", "title")
}


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "above", "before", "newest", "memo")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.parent, self.items = tag, attrs, parent, []
        # The element before, and the last child so far; what a selector has found out.
        self.before = parent.newest if parent else None
        self.newest = self.memo = None
        if parent:
            parent.newest = self
        # Tags of all ancestors; most nodes share their parent's set.
        over = parent.above if parent else frozenset()
        self.above = over if parent is None or parent.tag in over else over | {parent.tag}


class _Tree:
    """Open elements are a stack, with the places of each tag in it, so no tag climbs to the root."""

    def __init__(self):
        self.root = self.top = Node("html", NO_ATTRS, None)
        self.nodes = []
        self.stack = [self.root]
        self.places = {}  # tag -> ascending places in the stack, the root left out
        self.blocks = []  # places of block elements

    def _push(self, node):
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)
        self.top = node

    def _cut(self, place):
        """Close the element at a place of the stack and all inside it."""
        while len(self.stack) > place:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()
        self.top = self.stack[-1]

    def _last(self, tag):
        places = self.places.get(tag)
        return places[-1] if places else 0

    def open(self, tag, attrs):
        if tag == "html":
            return
        if tag in PARAGRAPH_ENDERS:
            self._close_nearest({"p"}, {"table", "td", "th", "button", "li"})
        if tag in SELF_ENDERS:
            self._close_nearest(*SELF_ENDERS[tag])
        node = Node(tag, attributes(attrs, True) if attrs and not attrs.isspace() else NO_ATTRS, self.top)
        self.top.items.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self._push(node)

    def _close_nearest(self, tags, fences):
        """Close the open elements among `tags`, not looking past a fence."""
        fence = max(map(self._last, fences))
        inside = []
        for tag in tags:
            places = self.places.get(tag, ())
            at = bisect_right(places, fence)
            if at < len(places):
                inside.append(places[at])
        if inside:
            self._cut(min(inside))

    def close(self, tag):
        if tag in ("html", "body"):
            return
        place = self._last(tag)
        crossed_block = bool(self.blocks) and self.blocks[-1] > place
        # A stray end tag, and a formatting end tag inside a later block, do not move text elsewhere.
        if place and not (tag in FORMATTING and crossed_block):
            self._cut(place)

    def text(self, data):
        if data:
            self.top.items.append(unescape(data) if "&" in data else data)


def attributes(source: str, bare: bool = False) -> dict[str, str]:
    """Attributes of a tag; of a repeated one the first counts. With `bare`, those without a value too, as ''."""
    found = {}
    for name, equals, double, single, plain in ATTRIBUTE.findall(source):
        if equals or bare:
            found.setdefault(name.lower(), unescape(double or single or plain))
    return found


def parse(html: str) -> tuple[Node, list[Node]]:
    """The root and all elements in document order. A tag cut off by the end of the page is ignored."""
    html = (html or "").replace("\r\n", "\n").replace("\r", "\n")
    tree, pos = _Tree(), 0
    while found := MARKUP.search(html, pos):
        tree.text(html[pos:found.start()])
        pos = found.end()
        name = found["name"] or found["loose"]
        if name is None or html[pos - 1] != ">":
            continue
        name = name.lower()
        if found["end"]:
            tree.close(name)
            continue
        tree.open(name, found["attrs"] or found["rest"] or "")
        if name in RAW_TEXT:
            stop = RAW_TEXT[name].search(html, pos)
            until = stop.start() if stop else len(html)
            inside = html[pos:until]
            if name in DECODED:
                tree.text(inside)
            elif inside:
                tree.top.items.append(inside)
            pos = until
    tree.text(html[pos:])
    return tree.root, tree.nodes


def first(nodes: list[Node], matches):
    return next((node for node in nodes if matches(node)), None)


def text_content(node: Node, drop=()) -> str:
    """All text below a node except in subtrees that match a drop rule."""
    out, stack = [], [iter(node.items)]
    while stack:
        for item in stack[-1]:
            if isinstance(item, str):
                out.append(item)
            elif not any(matches(item) for matches in drop):
                stack.append(iter(item.items))
                break
        else:
            stack.pop()
    return "".join(out)


def rendered(node: Node, styles: Styles | None = None) -> str:
    """Approximate visible text: blocks and <br> break lines, blanks collapse, scripts and styles are hidden, and so is
    what `styles` hide. Of an element that is not displayed itself, all text is taken."""
    if styles is None:
        styles = Styles([])
    pieces = []  # text, or a number of required line breaks, or None for <br>
    seen = True
    for over in reversed(_path(node)):
        displayed, visibility = styles.of(over)
        if not displayed:
            return text_content(node)
        seen = visibility in ("visible", "initial") if visibility not in (None, "inherit") else seen

    def margin(tag):
        return 2 if tag == "p" else 1 if tag in BLOCK else 0

    plain = not styles.any
    stack = [(node, iter(node.items), False, seen)]
    while stack:
        current, items, pre, seen = stack[-1]
        for item in items:
            if isinstance(item, str):
                if seen:
                    pieces.append((item if pre else SPACES.sub(" ", item), pre))
            elif item.tag == "br":
                pieces.append(None)
            elif item.tag not in HIDDEN:
                inner = seen
                if not plain or item.attrs or item.tag == "dialog":
                    displayed, visibility = styles.of(item)
                    if not displayed:
                        continue
                    if visibility not in (None, "inherit"):
                        inner = visibility in ("visible", "initial")
                if margin(item.tag):
                    pieces.append(margin(item.tag))
                stack.append((item, iter(item.items), pre or item.tag in ("pre", "textarea"), inner))
                break
        else:
            stack.pop()
            if current.tag in ("td", "th"):
                pieces.append(CELL_END)
            elif current.tag == "tr" and pieces and pieces[-1] is CELL_END:
                pieces.pop()
            if margin(current.tag) and stack:
                pieces.append(margin(current.tag))

    out, pending, line_start = [], 0, True
    for piece in pieces:
        if piece is None:
            _rstrip_blank(out)
            out.append("\n" * (pending if out else 0) + "\n")
            pending, line_start = 0, True
        elif isinstance(piece, int):
            pending = max(pending, piece)
        else:
            text, pre = piece
            if not pre:
                if line_start or pending or (out and out[-1][-1] in " \t"):
                    text = text.lstrip(" ")
            if not text:
                continue
            if pending:
                _rstrip_blank(out)
                if out:
                    out.append("\n" * pending)
                pending = 0
            out.append(text)
            line_start = False
    _rstrip_blank(out)
    return "".join(out)


def _path(node: Node) -> list[Node]:
    """The element and all around it."""
    out = []
    while node is not None:
        out.append(node)
        node = node.parent
    return out


def _rstrip_blank(out):
    if out and not out[-1].endswith("\n"):
        out[-1] = out[-1].rstrip(" ")
