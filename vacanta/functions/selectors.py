"""CSS selectors over the light tree of `markup`: a parser, and tests matched from right to left.

Known are types, `*`, `#id`, `.class`, `[attr]` with `=`, `~=`, `|=`, `^=`, `$=`, `*=` and the `i` flag, the combinators
blank, `>`, `+` and `~`, `:not()`, `:is()`, `:where()`, `:empty`, `:root`, `:first-child`, `:last-child`, `:only-child`,
`:nth-child()`, `:first-of-type`, `:last-of-type`, and lists. States a stored page does not have, such as `:hover`, and
pseudo-elements match nothing. Anything else is an error.
"""

import re

NAME = r"-?(?:[A-Za-z_\u0080-\U0010ffff]|\\.)(?:[\w\u0080-\U0010ffff-]|\\.)*|--[\w-]*"
ATTRIBUTE = re.compile(
    rf"""\[\s*({NAME})\s*(?:([~|^$*]?=)\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^\s\]"']+))\s*([iIsS])?\s*)?\]"""
)
SIMPLE = re.compile(rf"([#.])({NAME})")
TYPE = re.compile(rf"\*|{NAME}")
PSEUDO = re.compile(r"(::?)([A-Za-z-]+)(\()?")
COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
NTH = re.compile(r"([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+)")
# States and parts that a stored page does not have.
NEVER = {
    "hover", "focus", "focus-within", "focus-visible", "active", "visited", "target", "checked", "before", "after",
    "first-line", "first-letter", "selection", "placeholder", "marker", "backdrop", "fullscreen", "autofill", "popover-open",
}


class Unsupported(ValueError):
    """A selector that cannot be read."""


def unescaped(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name) if "\\" in name else name


class Compound:
    """Tests on one element: its tag, its classes and all others as functions."""

    __slots__ = ("tag", "classes", "ids", "tests", "weight")

    def __init__(self):
        self.tag, self.classes, self.ids, self.tests, self.weight = "", [], [], [], [0, 0, 0]

    def holds(self, node) -> bool:
        if self.tag and node.tag != self.tag:
            return False
        attrs = node.attrs
        if self.classes:
            own = attrs.get("class")
            if not own:
                return False
            own = own.split()
            if not all(c in own for c in self.classes):
                return False
        if self.ids and not all(attrs.get("id") == i for i in self.ids):
            return False
        return all(test(node) for test in self.tests)


class Selector:
    """One selector without commas: compounds from left to right, and what joins each to the one before."""

    __slots__ = ("compounds", "joins", "weight", "above", "key")

    def __init__(self, compounds: list[Compound], joins: list[str]):
        self.compounds, self.joins = compounds, joins
        self.weight = tuple(sum(c.weight[i] for c in compounds) for i in range(3))
        # Tags that must be among the ancestors, for a quick no.
        self.above = {
            c.tag for i, c in enumerate(compounds[:-1]) if c.tag and c.tag != "html" and all(j in (" ", ">") for j in joins[i + 1:])
        }
        self.key = id(self)

    def matches(self, node) -> bool:
        last = len(self.compounds) - 1
        if not self.compounds[last].holds(node):
            return False
        if not last:
            return True
        return node.above.issuperset(self.above) and self._left(node, last)

    def _upto(self, node, i: int) -> bool:
        return self.compounds[i].holds(node) and (i == 0 or self._left(node, i))

    def _left(self, node, i: int) -> bool:
        """Whether what stands left of compound i fits this element."""
        join = self.joins[i]
        if join == ">":
            return node.parent is not None and self._upto(node.parent, i - 1)
        if join == "+":
            return node.before is not None and self._upto(node.before, i - 1)
        return self._any(node, i - 1, "parent" if join == " " else "before")

    def _any(self, node, i: int, step: str) -> bool:
        """Whether compound i fits any ancestor, or any sibling before. Kept for each element, so that a page costs one
        pass per compound however it is nested."""
        key = (self.key, i, step)
        path, at = [], node
        while True:
            known = at.memo.get(key) if at.memo else None
            if known is not None:
                break
            path.append(at)
            at = getattr(at, step)
            if at is None:
                known = False
                break
        for here in reversed(path):
            over = getattr(here, step)
            known = over is not None and (known or self._upto(over, i))
            if here.memo is None:
                here.memo = {}
            here.memo[key] = known
        return known


def place(node) -> int:
    """1 for the first element of its parent. Kept on the elements, so that all siblings together cost one pass."""
    path, at, n = [], node, 0
    while at is not None:
        known = at.memo.get("place") if at.memo else None
        if known is not None:
            n = known
            break
        path.append(at)
        at = at.before
    for here in reversed(path):
        n += 1
        if here.memo is None:
            here.memo = {}
        here.memo["place"] = n
    return n


def nth(text: str):
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip().lower(), text.strip().lower())
    found = NTH.fullmatch(text)
    if not found:
        raise Unsupported(f":nth-child({text})")
    step, sign, offset, only = found.groups()
    if only is not None:
        return lambda node: place(node) == int(only)
    a = int(step + "1") if step in ("", "+", "-") else int(step)
    b = int((sign or "") + (offset or "0"))
    return lambda node: (lambda d: d == 0 if a == 0 else d % a == 0 and d // a >= 0)(place(node) - b)


def attribute_test(name: str, op: str | None, value: str, fold: bool):
    """A test of one attribute; `fold` ignores the case of letters."""
    name = name.lower()
    if op is None:
        return lambda node: name in node.attrs
    value = value.lower() if fold else value
    if op in ("^=", "$=", "*=", "~=") and not value:
        return lambda node: False
    compare = {
        "=": lambda own: own == value, "~=": lambda own: value in own.split(), "^=": lambda own: own.startswith(value),
        "|=": lambda own: own == value or own.startswith(value + "-"), "$=": lambda own: own.endswith(value),
        "*=": lambda own: value in own,
    }[op]

    def test(node) -> bool:
        own = node.attrs.get(name)
        return own is not None and compare(own.lower() if fold else own)

    return test


def same_tag(node, last: bool) -> bool:
    """Whether an element is the first, or the last, of its tag among its siblings."""
    over = node.parent
    if over is None:
        return True
    if over.memo is None:
        over.memo = {}
    ends = over.memo.get("ends")
    if ends is None:
        ends = over.memo["ends"] = ({}, {})
        for child in over.items:
            if not isinstance(child, str):
                ends[0].setdefault(child.tag, child)
                ends[1][child.tag] = child
    return ends[last][node.tag] is node


def is_last(node) -> bool:
    return node.parent is None or node.parent.newest is node


POSITIONS = {
    "first-child": lambda node: node.before is None,
    "last-child": is_last,
    "only-child": lambda node: node.before is None and is_last(node),
    "first-of-type": lambda node: same_tag(node, False),
    "last-of-type": lambda node: same_tag(node, True),
    "empty": lambda node: not any(not isinstance(i, str) or i for i in node.items),
    "root": lambda node: node.parent is None,
}


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def list(self, closing: str = "") -> list[Selector]:
        out = []
        while True:
            self._blanks()
            out.append(self.complex(closing))
            self._blanks()
            if self.text.startswith(",", self.at):
                self.at += 1
            elif closing and self.text.startswith(closing, self.at):
                self.at += 1
                return out
            elif self.at == len(self.text) and not closing:
                return out
            else:
                raise Unsupported(self.text)

    def _blanks(self) -> None:
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def complex(self, closing: str) -> Selector:
        compounds, joins = [self.compound()], [""]
        while self.at < len(self.text):
            found = COMBINATOR.match(self.text, self.at)
            after = found.end() if found else self.at
            if not found or after == len(self.text) or self.text[after] == "," or closing and self.text[after] == closing:
                break
            self.at = after
            joins.append(found[1] or " ")
            compounds.append(self.compound())
        return Selector(compounds, joins)

    def compound(self) -> Compound:
        out, text, begin = Compound(), self.text, self.at
        if found := TYPE.match(text, self.at):
            self.at = found.end()
            if found[0] != "*":
                out.tag, out.weight[2] = unescaped(found[0]).lower(), 1
        while self.at < len(text):
            if found := SIMPLE.match(text, self.at):
                name = unescaped(found[2])
                (out.ids if found[1] == "#" else out.classes).append(name)
                out.weight[0 if found[1] == "#" else 1] += 1
                self.at = found.end()
            elif found := ATTRIBUTE.match(text, self.at):
                name, op, double, single, bare, flag = found.groups()
                value = unescaped(next((v for v in (double, single, bare) if v is not None), ""))
                out.tests.append(attribute_test(unescaped(name), op, value, (flag or "").lower() == "i"))
                out.weight[1] += 1
                self.at = found.end()
            elif found := PSEUDO.match(text, self.at):
                self.at = found.end()
                self._pseudo(out, found[1], found[2].lower(), bool(found[3]))
            else:
                break
        if self.at == begin:
            raise Unsupported(text)
        return out

    def _pseudo(self, out: Compound, colons: str, name: str, opens: bool) -> None:
        if name in ("not", "is", "where") and opens:
            inner = self.list(")")
            wanted = name != "not"
            out.tests.append(lambda node: any(s.matches(node) for s in inner) == wanted)
            if name != "where":
                heaviest = max(s.weight for s in inner)
                out.weight = [a + b for a, b in zip(out.weight, heaviest)]
        elif name == "nth-child" and opens:
            end = self.text.find(")", self.at)
            if end < 0:
                raise Unsupported(self.text)
            out.tests.append(nth(self.text[self.at:end]))
            out.weight[1] += 1
            self.at = end + 1
        elif name in POSITIONS and not opens:
            out.tests.append(POSITIONS[name])
            out.weight[1] += 1
        elif (name in NEVER or colons == "::") and not opens:
            out.tests.append(lambda node: False)
        else:
            raise Unsupported(self.text)


def parse_selector(text: str) -> list[Selector]:
    """The selectors of a list; raises `Unsupported` where one cannot be read."""
    return _Parser(text).list()


def compile_selector(text: str):
    """A test of an element for a selector or a list of them."""
    parsed = parse_selector(text)
    if len(parsed) == 1:
        only = parsed[0]
        return only.compounds[0].holds if len(only.compounds) == 1 else only.matches

    return lambda node: any(s.matches(node) for s in parsed)
