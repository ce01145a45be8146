"""A finite CSS cascade: selectors with combinators, specificity, inheritance, sizes in points."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

#: What is inherited, what is known, and what a page starts from.
INHERITED = frozenset({"color", "font-family", "font-size", "font-weight", "font-style", "text-align", "white-space"})
KNOWN = INHERITED | {"background-color", "text-decoration", "vertical-align", "display"}
INITIAL = {"color": "black", "font-size": "12pt", "font-weight": "normal", "font-style": "normal", "white-space": "normal"}
HEADING_SIZES = {"h1": "24pt", "h2": "18pt", "h3": "14pt", "h4": "12pt", "h5": "10pt", "h6": "9pt"}
BOLD_TAGS, ITALIC_TAGS = ("b", "strong", "th", *HEADING_SIZES), ("i", "em", "cite", "var", "dfn")
POINTS = {"pt": 1.0, "px": 0.75, "in": 72.0, "cm": 72 / 2.54, "mm": 72 / 25.4, "pc": 12.0}
NAMED_SIZES = {"xx-small": 7.0, "x-small": 7.5, "small": 10.0, "medium": 12.0, "large": 13.5, "x-large": 18.0, "xx-large": 24.0}
MOST_COMPOUNDS = 32

_COMPOUND = re.compile(r"""([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]|:([\w-]+)""")


@dataclass
class Compound:
    tag: str = ""
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attributes: list[tuple[str, str, str]] = field(default_factory=list)
    pseudo: list[str] = field(default_factory=list)

    def fits(self, node) -> bool:
        if self.tag and self.tag != "*" and self.tag != node.tag:
            return False
        own = (node.attrs.get("class") or "").split()
        if any(i != node.attrs.get("id") for i in self.ids) or any(c not in own for c in self.classes):
            return False
        if not all(_attribute(node.attrs.get(n) if n in node.attrs else None, op, v) for n, op, v in self.attributes):
            return False
        kin = [c for c in node.parent.children if not isinstance(c, str)] if node.parent else [node]
        tests = {"first-child": kin[0] is node, "last-child": kin[-1] is node, "only-child": len(kin) == 1, "root": node.tag == "html", "empty": not node.children}
        return all(tests.get(p, False) for p in self.pseudo)


def _attribute(have: str | None, op: str, want: str) -> bool:
    if have is None:
        return False
    tests = {"": lambda: True, "=": lambda: have == want, "~=": lambda: want in have.split(), "|=": lambda: have == want or have.startswith(want + "-"), "^=": lambda: bool(want) and have.startswith(want), "$=": lambda: bool(want) and have.endswith(want), "*=": lambda: bool(want) and want in have}
    return tests[op]()


@dataclass
class Selector:
    compounds: list[Compound]
    relations: list[str]

    @property
    def specificity(self) -> tuple[int, int, int]:
        c = self.compounds
        return sum(len(x.ids) for x in c), sum(len(x.classes) + len(x.attributes) + len(x.pseudo) for x in c), sum(bool(x.tag and x.tag != "*") for x in c)

    def fits(self, node) -> bool:
        return self.compounds[-1].fits(node) and self._left(node, len(self.compounds) - 2)

    def _left(self, node, k: int) -> bool:
        if k < 0:
            return True
        relation, want = self.relations[k], self.compounds[k]
        if relation in "+~":
            kin = [c for c in node.parent.children if not isinstance(c, str)] if node.parent else []
            before = kin[: kin.index(node)] if node in kin else []
            chain = before[-1:] if relation == "+" else before
        else:
            chain, up = [], node.parent
            while up is not None and up.tag:
                chain.append(up)
                if relation == ">":
                    break
                up = up.parent
        return any(want.fits(x) and self._left(x, k - 1) for x in chain)


def parse_selector(text: str) -> Selector | None:
    """None for what isn't known: other pseudo classes, empty parts, too many compounds."""
    tokens = re.findall(r"\s*[>+~]\s*|\s+|(?:\[[^\]]*\]|[^\s>+~\[])+", text.strip())
    compounds, relations, after = [], [], True
    for t in tokens:
        if not t.strip() or t.strip() in ">+~":
            if after:
                return None
            relations.append(t.strip() or " ")
            after = True
            continue
        one, at = Compound(), 0
        for m in _COMPOUND.finditer(t):
            if m.start() != at:
                return None
            at = m.end()
            tag, ident, cls, name, op, a, b, c, pseudo = m.groups()
            if tag:
                one.tag = tag.lower()
            elif ident:
                one.ids.append(ident)
            elif cls:
                one.classes.append(cls)
            elif name:
                one.attributes.append((name.lower(), op or "", a or b or c or ""))
            elif pseudo in ("first-child", "last-child", "only-child", "root", "empty"):
                one.pseudo.append(pseudo)
            else:
                return None
        if at != len(t) or not t:
            return None
        compounds.append(one)
        after = False
    return Selector(compounds, relations) if compounds and not after and len(compounds) <= MOST_COMPOUNDS else None


def without_comments(text: str) -> str:
    """Comments go, those in strings stay."""
    return re.sub(r"""("(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|/\*.*?(?:\*/|$)""", lambda m: m[1] or " ", text, flags=re.S)


_PART = re.compile(r"""(?:[^;"']|"[^"]*"?|'[^']*'?)+""")


def declarations(text: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) in order; semicolons in strings part nothing."""
    out = []
    for part in _PART.findall(text):
        name, colon, value = part.partition(":")
        value, n = re.subn(r"\s*!\s*important\s*$", "", value.strip(), flags=re.I)
        if colon and name.strip() and value:
            out.append((name.strip().lower(), value, bool(n)))
    return out


def rules(text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """((selector, declarations) pairs, at-rules that were left out); ``@media all`` and ``screen`` are read."""
    text, out, skipped, i = without_comments(text), [], [], 0
    while i < len(text):
        brace = text.find("{", i)
        semi = text.find(";", i)
        head = text[i : brace if brace >= 0 else len(text)].strip()
        if head.startswith("@") and 0 <= semi < (brace if brace >= 0 else len(text)):
            skipped.append(text[i:semi].strip())
            i = semi + 1
            continue
        if brace < 0:
            break
        depth, j = 1, brace + 1
        while j < len(text) and depth:
            depth += {"{": 1, "}": -1}.get(text[j], 0)
            j += 1
        body = text[brace + 1 : j - 1 if not depth else j]
        if head.startswith("@"):
            if re.fullmatch(r"@media\s+(all|screen)\s*", head):
                more, lost = rules(body)
                out += more
                skipped += lost
            else:
                skipped.append(head)
        elif head:
            out.append((head, body))
        i = j
    return out, skipped


def _tag_defaults() -> dict[str, dict[str, str]]:
    out: dict[str, dict[str, str]] = {t: {"font-size": v} for t, v in HEADING_SIZES.items()}
    for tags, name, value in ((BOLD_TAGS, "font-weight", "bold"), (ITALIC_TAGS, "font-style", "italic"), (("pre",), "white-space", "pre"), (("u", "ins"), "text-decoration", "underline"), (("s", "del"), "text-decoration", "line-through")):
        for t in tags:
            out.setdefault(t, {})[name] = value
    return out


TAG_DEFAULTS = _tag_defaults()
#: What a keyword takes a property's value from: the parent, the start of a page, or one of them by property.
_KEYWORDS = {"inherit": lambda n: True, "initial": lambda n: False, "unset": INHERITED.__contains__}


class Cascade:
    """Computed styles of a tree's elements under its sheets.

    The compounds of all selectors are numbered. One pass over the children of an element finds which of
    them match, as bits, from the bits of the parent and of the siblings before; candidates come from an index
    by id, class and tag. So matching is linear in the tree, however deep it is and however the selectors
    are combined."""

    def __init__(self, sheets: list[str]):
        self._read = read = _sheets(tuple(sheets))
        self.warnings: list[str] = list(read.warnings)
        # an element's place: which compounds it matches, and which it or an element above it
        self._places: dict[int, tuple[int, int]] = {}
        self._last = read.last
        self._styles: dict[int, dict[str, str]] = {}

    def _settle(self, parent) -> None:
        """Places of all elements right below ``parent``, whose own is known."""
        by, compounds = self._read.by, self._read.compounds
        over_here, over_above = self._places.get(id(parent), (0, 0))
        previous = before = 0
        for c in parent.children:
            if isinstance(c, str):
                continue
            keys = ["*", c.tag]
            if c.attrs:
                keys += [f".{x}" for x in dict.fromkeys((c.attrs.get("class") or "").split())]
                if c.attrs.get("id"):
                    keys.append(f"#{c.attrs['id']}")
            here = 0
            for key in keys:
                for k in by.get(key, ()):
                    one, relation = compounds[k]
                    left = None if relation is None else over_above if relation == " " else over_here if relation == ">" else previous if relation == "+" else before
                    if (left is None or left >> (k - 1) & 1) and one.fits(c):
                        here |= 1 << k
            self._places[id(c)] = here, over_above | here
            previous, before = here, before | here

    def style(self, node) -> dict[str, str]:
        """Important before inline before specificity before order; the later of equals wins."""
        if node is not None and (known := self._styles.get(id(node))) is not None:
            return known
        chain = []
        while node is not None and node.tag and id(node) not in self._styles:
            chain.append(node)
            node = node.parent
        style = self._styles[id(node)] if node is not None and node.tag else INITIAL
        for own in reversed(chain):
            if self._read.by and own.parent is not None and id(own) not in self._places:
                self._settle(own.parent)
            style = self._styles[id(own)] = self._computed(own, style)
        return style

    def _computed(self, node, parent: dict[str, str]) -> dict[str, str]:
        """Elements without a style of their own whose tag, matches and parent's style are those of an earlier one share
        its style, on any page with the same sheets."""
        bits = self._places.get(id(node), (0, 0))[0] & self._read.ends
        if inline := node.attrs.get("style"):
            own = [d for k in self._matched(node) for d in self._last[k]] + [((important, True, (0, 0, 0), 0, i), n, v) for i, (n, v, important) in enumerate(_known(declarations(inline), self.warnings))]
            return _cascaded(node.tag, own, parent)
        key = node.tag if node.tag in TAG_DEFAULTS else "", bits, id(parent)
        if (held := self._read.computed.get(key)) is None:
            if len(self._read.computed) >= MOST_COMPUTED:
                self._read.computed.clear()
            # with the parent's style, so that its id isn't given to another one
            held = self._read.computed[key] = _cascaded(node.tag, [d for k in self._matched(node) for d in self._last[k]], parent), parent
        return held[0]

    def _matched(self, node):
        bits = self._places.get(id(node), (0, 0))[0] & self._read.ends
        while bits:
            low = bits & -bits
            yield low.bit_length() - 1
            bits ^= low


class _Sheets:
    """The compounds of sheets, by what is looked up, and the declarations of the selectors that end in one."""

    def __init__(self, sheets: tuple[str, ...]):
        self.warnings: list[str] = []
        self.compounds: list[tuple[Compound, str | None]] = []  # with the relation to the one before it
        self.by: dict[str, list[int]] = {}
        self.last: dict[int, list[tuple[tuple, str, str]]] = {}
        self.ends = 0
        self.computed: dict[tuple, tuple[dict[str, str], dict[str, str]]] = {}
        order = 0
        for sheet in sheets:
            found, skipped = rules(sheet)
            self.warnings += [f"unsupported rule {x.split()[0]}" for x in skipped]
            for heads, body in found:
                for head in heads.split(","):
                    selector = parse_selector(head)
                    if selector is None:
                        self.warnings.append(f"unsupported selector {head.strip()}")
                        continue
                    self._add(selector, _known(declarations(body), self.warnings), order)
                    order += 1

    def _add(self, selector: Selector, found: list[tuple[str, str, bool]], order: int) -> None:
        for k, one in enumerate(selector.compounds):
            key = f"#{one.ids[0]}" if one.ids else f".{one.classes[0]}" if one.classes else one.tag or "*"
            self.by.setdefault(key, []).append(len(self.compounds))
            self.compounds.append((one, selector.relations[k - 1] if k else None))
        end = len(self.compounds) - 1
        self.ends |= 1 << end
        self.last[end] = [((important, False, selector.specificity, order, i), name, value) for i, (name, value, important) in enumerate(found)]


#: Sheets of this length at most are kept for the pages that follow; longer ones are read for each.
MOST_KEPT = 1 << 14
MOST_COMPUTED = 4096
_kept_sheets = lru_cache(64)(_Sheets)


def _sheets(texts: tuple[str, ...]) -> _Sheets:
    return _kept_sheets(texts) if sum(map(len, texts)) <= MOST_KEPT else _Sheets(texts)


def _known(found: list[tuple[str, str, bool]], warnings: list[str]) -> list[tuple[str, str, bool]]:
    out = []
    for name, value, important in found:
        name = {"background": "background-color", "text-decoration-line": "text-decoration"}.get(name, name)
        if name in KNOWN:
            out.append((name, value, important))
        else:
            warnings.append(f"unsupported property {name}")
    return out


def _cascaded(tag: str, declared: list[tuple[tuple, str, str]], parent: dict[str, str]) -> dict[str, str]:
    best: dict[str, tuple[tuple, str]] = {n: ((), v) for n, v in TAG_DEFAULTS.get(tag, {}).items()}
    for rank, name, value in declared:
        if name not in best or rank >= best[name][0]:
            best[name] = rank, value
    out = {}
    for name in sorted(KNOWN):
        if name in best:
            value = best[name][1].strip()
            if keyword := _KEYWORDS.get(value.lower()):
                value = (parent if keyword(name) else INITIAL).get(name)
            if name == "font-size":
                mine = size_points(parent.get(name, "12pt"))
                value = f"{size_points(value or '12pt', mine):g}pt"
        else:  # a decoration is drawn through what is inside
            value = parent.get(name) if name in INHERITED or name == "text-decoration" else None
        if value is not None:
            out[name] = value
    return out


def size_points(value: str, parent: float = 12.0, root: float = 12.0) -> float:
    """A font size in points; what isn't known is the parent's."""
    v = value.strip().lower()
    if v in NAMED_SIZES:
        return NAMED_SIZES[v]
    if v in ("smaller", "larger"):
        return parent * (1 / 1.2 if v == "smaller" else 1.2)
    m = re.fullmatch(r"([0-9]*\.?[0-9]+)\s*(pt|px|in|cm|mm|pc|em|rem|%)", v)
    if not m:
        return parent
    n, unit = float(m[1]), m[2]
    return n * {"em": parent, "rem": root, "%": parent / 100}.get(unit, POINTS.get(unit, 1.0))
