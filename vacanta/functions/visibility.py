"""Which elements of a page are shown: `display` and `visibility` by style sheets, inline styles and attributes.

Only rules that set one of the two are kept. Of the declarations that apply to an element the winner is an important one,
then an inline one, then the one with the heavier selector, then the later one. Sheets for other media than a screen, and
rules within conditions, do not apply; neither do sheets in other files.
"""

import re

from vacanta.functions.selectors import Unsupported, parse_selector

COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
MENTIONS = re.compile(r"display|visibility", re.I)
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([^;!]+?)\s*(!\s*important\s*)?(?=;|$)", re.I)
SCREEN = re.compile(r"@media\s+(?:(?:only\s+)?(?:screen|all)\s*(?:,|$)|[^,{]+,\s*(?:only\s+)?(?:screen|all)\s*(?:,|$))", re.I)
SHEET_MEDIA = re.compile(r"(?:^|,)\s*(?:only\s+)?(?:screen|all)?\s*(?:,|$)", re.I)
INLINE = (1 << 30, 0, 0)


def declarations(block: str) -> list[tuple[str, str, bool]]:
    """`display` and `visibility` in a block: property, value, whether it is important."""
    return [(m[1].lower(), m[2].strip().lower(), bool(m[3])) for m in DECLARATION.finditer(block)] if MENTIONS.search(block) else []


def _end(css: str, at: int, stops: str) -> int:
    """The first of these characters from a place on, not counting those in strings; the end where there is none."""
    while at < len(css) and css[at] not in stops:
        if css[at] in "\"'":
            quote, at = css[at], at + 1
            while at < len(css) and css[at] != quote:
                at += 2 if css[at] == "\\" else 1
        at += 1
    return min(at, len(css))


def rules(css: str):
    """Selector lists and blocks of a sheet, those within a screen's media rules too."""
    css = COMMENT.sub(" ", css)
    begin = 0
    while begin < len(css):
        at = _end(css, begin, "{};")
        if at == len(css):
            return
        head = css[begin:at].strip()
        if css[at] != "{":
            begin = at + 1  # @import and the like, or the end of a screen's rules
        elif head.startswith("@"):
            if SCREEN.match(head):
                begin = at + 1  # go on inside
                continue
            depth = 1
            while depth and at < len(css):
                at = _end(css, at + 1, "{}")
                depth += {"{": 1, "}": -1}.get(css[at:at + 1], 0)
            begin = at + 1
        else:
            end = _end(css, at + 1, "}")
            yield head, css[at + 1:end]
            begin = end + 1


class Styles:
    """The sheets of one page. Rules are found by the id, a class or the tag of their last compound."""

    def __init__(self, nodes: list):
        self.by_id, self.by_class, self.by_tag, self.all, order = {}, {}, {}, [], 0
        for node in nodes:
            if node.tag != "style" or not SHEET_MEDIA.search(node.attrs.get("media", "")):
                continue
            css = "".join(i for i in node.items if isinstance(i, str))
            if not MENTIONS.search(css):
                continue
            for head, block in rules(css):
                said = declarations(block)
                if not said:
                    continue
                try:
                    selectors = parse_selector(head)
                except Unsupported:
                    continue  # as in a browser, a list that cannot be read takes its rule with it
                for selector in selectors:
                    order += 1
                    last = selector.compounds[-1]
                    entry = (selector, order, said)
                    if last.ids:
                        self.by_id.setdefault(last.ids[0], []).append(entry)
                    elif last.classes:
                        self.by_class.setdefault(last.classes[0], []).append(entry)
                    elif last.tag:
                        self.by_tag.setdefault(last.tag, []).append(entry)
                    else:
                        self.all.append(entry)
        self.any = order > 0

    def _found(self, node):
        attrs = node.attrs
        if attrs and self.by_id:
            yield from self.by_id.get(attrs.get("id"), ())
        if attrs and self.by_class:
            for name in dict.fromkeys(attrs.get("class", "").split()):
                yield from self.by_class.get(name, ())
        yield from self.by_tag.get(node.tag, ())
        yield from self.all

    def of(self, node) -> tuple[bool, str | None]:
        """Whether the element is displayed, and the visibility that is set on it."""
        won: dict[str, tuple] = {}
        if self.any:
            for selector, order, said in self._found(node):
                if selector.matches(node):
                    for name, value, important in said:
                        won[name] = max(won.get(name, ((),)), ((important, selector.weight, order), value), key=lambda w: w[0])
        inline = node.attrs.get("style") if node.attrs else None
        for name, value, important in declarations(inline) if inline else ():
            won[name] = max(won.get(name, ((),)), ((important, INLINE, 0), value), key=lambda w: w[0])
        if "display" in won:
            displayed = won["display"][1] != "none"
        else:
            displayed = not (node.attrs and "hidden" in node.attrs or node.tag == "dialog" and "open" not in node.attrs)
        return displayed, won["visibility"][1] if "visibility" in won else None
