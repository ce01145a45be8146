"""LaTeX sources: a lexer with source spans, and a finite reader that executes nothing."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MOST_TOKENS = 250_000
HEADINGS = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
BOOK_SHIFT = {"section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "u": "\u0306", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "d": "\u0323", "b": "\u0331"}
WORDS = {"textbackslash": "\\", "ldots": "…", "dots": "…", "textendash": "–", "textemdash": "—", "ss": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "o": "ø", "O": "Ø", "aa": "å", "AA": "Å", "l": "ł", "L": "Ł", "i": "ı", "j": "ȷ", "quad": " ", "qquad": " ", "LaTeX": "LaTeX", "TeX": "TeX"}
STYLES = {"textbf": "bold", "textit": "italic", "emph": "italic", "underline": "underline", "textsuperscript": "super", "textsubscript": "sub", "texttt": "mono"}
MATH = {"equation", "equation*", "align", "align*", "gather", "gather*", "multline", "multline*", "displaymath", "math"}
LISTS = {"itemize", "enumerate", "description"}
_TOKEN = re.compile(r"(?P<comment>%[^\n]*\n?[ \t]*)|\\(?P<command>[A-Za-z@]+)\*?[ \t]*|\\(?P<escape>.)|(?P<paragraph>\n[ \t]*\n\s*)|(?P<symbol>[{}$&\[\]#~])|(?P<text>[^\\%{}$&\[\]#~\n]+|\n)", re.S)


def tokens(source: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end): commands, symbols, paragraph ends and texts; comments are dropped."""
    out = []
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup
        if kind == "comment":
            continue
        value = m[kind]
        out.append(("command" if kind == "escape" else kind, value, m.start(), m.end()))
        if len(out) > MOST_TOKENS:
            raise ValueError("too-many-tokens")
    return out


class Reader:
    """Blocks (paragraphs, headings, list items, formulas, tables) and labels of a document's body."""

    def __init__(self, source: str):
        self.tokens = tokens(source)
        begin = re.search(r"\\begin\s*\{document\}", source)
        self.start = begin.end() if begin else 0
        cls = re.search(r"\\documentclass(?:\[[^\]]*\])?\{(\w+)\}", source)
        self.cls = cls[1] if cls else "article"
        self.blocks: list[dict] = []
        self.labels: list[str] = []
        self.issues: list[str] = []
        self._text: list[str] = []
        self._from: int | None = None
        self._lists: list[list] = []
        self.i = 0
        self._walk()

    def _flush(self, end: int, kind: str = "paragraph", level: int = 0) -> None:
        text = unicodedata.normalize("NFC", re.sub(r"[ \n\t]+", " ", "".join(self._text))).strip()
        if text:
            own = self._lists[-1] if self._lists else None
            self.blocks.append({"pos": len(self.blocks), "kind": "item" if own and kind == "paragraph" else kind, "level": level, "text": text, "list_kind": own[0] if own else None, "list_depth": len(self._lists) if own else None, "list_value": own[1] if own else None, "start": self._from or 0, "end": end})
        self._text, self._from = [], None

    def _group(self) -> str:
        """The source text of the next group or token, as plain text."""
        while self.i < len(self.tokens) and self.tokens[self.i][0] == "text" and not self.tokens[self.i][1].strip():
            self.i += 1
        if self.i >= len(self.tokens):
            return ""
        kind, value, _, _ = self.tokens[self.i]
        if (kind, value) != ("symbol", "{"):
            self.i += 1
            return value if kind == "text" else ""
        self.i += 1
        depth, out = 1, []
        while self.i < len(self.tokens) and depth:
            kind, value, _, _ = self.tokens[self.i]
            self.i += 1
            if kind == "symbol" and value in "{}":
                depth += 1 if value == "{" else -1
            elif kind == "command" and value in ACCENTS:
                out.append(self._accent(value))
            elif kind == "command":
                out.append(WORDS.get(value, value if len(value) == 1 and not value.isalpha() else ""))
            elif kind == "symbol" and value == "~":
                out.append("\u00a0")
            else:
                out.append(" " if kind == "paragraph" else value)
        return "".join(out)

    def _option(self) -> str | None:
        if self.i < len(self.tokens) and self.tokens[self.i][:2] == ("symbol", "["):
            out = []
            self.i += 1
            while self.i < len(self.tokens) and self.tokens[self.i][:2] != ("symbol", "]"):
                out.append(self.tokens[self.i][1])
                self.i += 1
            self.i += 1
            return "".join(out)
        return None

    def _accent(self, mark: str) -> str:
        base = self._group()
        return base[:1].replace("ı", "i") + ACCENTS[mark] + base[1:] if base else ""

    def _until(self, name: str) -> str:
        """Raw values up to the end of an environment."""
        out = []
        while self.i < len(self.tokens):
            kind, value, _, _ = self.tokens[self.i]
            self.i += 1
            if kind == "command" and value == "end":
                at = self.i
                if self._group() == name:
                    return "".join(out)
                self.i = at
            out.append(("\\" + value + (" " if value.isalpha() else "")) if kind == "command" else value)
        self.issues.append(f"environment {name} isn't closed")
        return "".join(out)

    def _math(self, close: tuple[str, str]) -> str:
        out = []
        while self.i < len(self.tokens):
            kind, value, _, _ = self.tokens[self.i]
            self.i += 1
            if (kind, value) == close:
                return "".join(out)
            out.append(("\\" + value + (" " if value.isalpha() else "")) if kind == "command" else value)
        self.issues.append("formula isn't closed")
        return "".join(out)

    def _formula(self, text: str, start: int, end: int) -> None:
        self._flush(start)
        self._text, self._from = [re.sub(r"\\label\s*\{([^}]*)\}", lambda m: self.labels.append(m[1]) or "", text)], start
        self._flush(end, "formula")

    def _walk(self) -> None:
        while self.i < len(self.tokens):
            kind, value, start, end = self.tokens[self.i]
            self.i += 1
            if start < self.start:
                continue
            if self._from is None and (kind != "text" or value.strip()):
                self._from = start
            if kind == "paragraph":
                self._flush(start)
            elif kind == "text":
                self._text.append(value)
            elif kind == "symbol":
                if value == "~":
                    self._text.append("\u00a0")
                elif value == "$":
                    double = self.i < len(self.tokens) and self.tokens[self.i][:2] == ("symbol", "$")
                    if double:
                        self.i += 1
                        self._formula(self._math(("symbol", "$")), start, end)
                        self.i += self.i < len(self.tokens) and self.tokens[self.i][:2] == ("symbol", "$")
                    else:
                        self._text.append(self._math(("symbol", "$")))
                elif value in "[]&#":
                    self._text.append(value)
            elif value == "end":
                name = self._group()
                if name == "document":
                    break
                if name in LISTS and self._lists:
                    self._flush(start)
                    self._lists.pop()
            elif value == "begin":
                self._begin(self._group(), start)
            elif value == "item" and self._lists:
                self._flush(start)
                self._lists[-1][1] += 1
                if (label := self._option()) is not None:
                    self._text.append(label + " ")
                self._from = start
            elif value in HEADINGS:
                self._flush(start)
                self._option()
                level = BOOK_SHIFT.get(value, 1) if self.cls in ("book", "report") else HEADINGS[value]
                self._text, self._from = [self._group()], start
                self._flush(self.tokens[self.i - 1][3], "heading", level)
            elif value == "label":
                self.labels.append(self._group())
            elif value in ("ref", "eqref", "pageref", "cite"):
                self._option()
                self._text.append(f"[{self._group()}]")
            elif value == "(":
                self._text.append(self._math(("command", ")")))
            elif value == "[":
                self._formula(self._math(("command", "]")), start, end)
            elif value in ACCENTS and (len(value) > 1 or not value.isalpha() or self.tokens[self.i : self.i + 1] and self.tokens[self.i][1] == "{"):
                self._text.append(self._accent(value))
            elif value in STYLES:
                self._text.append(self._group())
            elif value in ("href", "url"):
                target = self._group()
                self._text.append(self._group() if value == "href" else target)
            elif value in WORDS:
                self._text.append(WORDS[value])
            elif value == "\\":
                self._text.append("\n")
            elif len(value) == 1 and not value.isalpha():
                self._text.append(value)
            else:
                self.issues.append(f"unknown command {value}")
        self._flush(self.tokens[-1][3] if self.tokens else 0)

    def _begin(self, name: str, start: int) -> None:
        if name in LISTS:
            self._flush(start)
            self._lists.append([name, 0])
        elif name in MATH:
            self._formula(self._until(name), start, self.tokens[min(self.i, len(self.tokens)) - 1][3])
        elif name in ("tabular", "longtable", "tabularx"):
            self._flush(start)
            columns = self._group()
            if name == "tabularx":
                columns = self._group()
            rows = table_rows(self._until(name))
            self._text, self._from = ["\n".join(" | ".join(r) for r in rows)], start
            text = "".join(self._text)
            self.blocks.append({"pos": len(self.blocks), "kind": "table", "level": len(column_tokens(columns) or []), "text": text, "list_kind": None, "list_depth": None, "list_value": None, "start": start, "end": self.tokens[self.i - 1][3]})
            self._text, self._from = [], None
        elif name in ("verbatim", "lstlisting", "comment"):
            raw = self._until(name)
            if name != "comment":
                self._flush(start)
                self._text, self._from = [raw], start
                self._flush(start, "code")
        elif name not in ("document", "table", "figure", "center", "abstract", "quote", "quotation", "flushleft", "flushright"):
            self.issues.append(f"unknown environment {name}")


def column_tokens(spec: str) -> list[str] | None:
    """One token per column of a column specification; ``*{n}{...}`` is spelled out; None if it isn't known."""
    spec = re.sub(r"\*\s*(\d{1,2})\s*([lcrX])", lambda m: m[2] * int(m[1]), re.sub(r"\*\{(\d{1,2})\}\{([lcrX|]+)\}", lambda m: m[2] * int(m[1]), spec))
    spec = re.sub(r"[@!><]\{[^{}]*\}", "", spec).replace("|", "").replace(" ", "")
    found = re.findall(r"[lcrX]|[pmb]\{[^{}]*\}|[pmb]", spec)
    return found if "".join(found) == spec else None


def table_rows(raw: str) -> list[list[str]]:
    """Cells of a tabular's source; rules vanish, ``\\multicolumn`` cells are repeated over their span."""
    raw = re.sub(r"\\(hline|toprule|midrule|bottomrule)\s*|\\c(mid)?(line|rule)\s*\{[^}]*\}", "", raw)
    out = []
    for line in re.split(r"\\\\(?:\[[^\]]*\])?", raw):
        cells = []
        for cell in re.split(r"(?<!\\)&", line):
            m = re.match(r"\s*\\multicolumn\s*\{?(\d+)\}?\s*\{?[^{}]*\}?\s*\{?(.*?)\}?\s*$", cell, re.S)
            n, text = (int(m[1]), m[2]) if m else (1, cell)
            cells += [re.sub(r"\s+", " ", re.sub(r"\\([&%$#_{}])", r"\1", text)).strip()] * n
        if any(cells):
            out.append(cells)
    return out


_BLOCK = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("list_kind", pa.string()), ("list_depth", pa.int32()), ("list_value", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_DDL = "struct<pos: int, kind: string, level: int, text: string, list_kind: string, list_depth: int, list_value: int, start: int, end: int>"


def read_tex(source: Column) -> Column:
    """struct(blocks, labels, issues)."""
    kind = pa.struct([("blocks", pa.list_(_BLOCK)), ("labels", pa.list_(pa.string())), ("issues", pa.list_(pa.string()))])

    def run(rows: pa.Array) -> pa.Array:
        out = []
        for s in rows.to_pylist():
            try:
                r = None if s is None else Reader(s)
                out.append(None if r is None else {"blocks": r.blocks, "labels": r.labels, "issues": list(dict.fromkeys(r.issues))})
            except ValueError as e:
                out.append({"blocks": [], "labels": [], "issues": [str(e)]})
        return pa.array(out, kind)

    return F.arrow_udf(run, f"struct<blocks: array<{_DDL}>, labels: array<string>, issues: array<string>>")(source)


def token_table(docs: DataFrame, row_id: str, source: str = "source") -> DataFrame:
    """(row_id, ix, kind, value, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([None if s is None else [dict(zip(("kind", "value", "start", "end"), t, strict=True)) for t in tokens(s)] for s in rows.to_pylist()], kind)

    found = F.arrow_udf(run, "array<struct<kind: string, value: string, start: int, end: int>>")(F.col(source))
    return docs.select(row_id, F.posexplode(found).alias("ix", "_t")).select(row_id, "ix", "_t.*")


#: Commands with their number of braced arguments, symbols, environments, delimiters and limits of formulas.
MATH_ARGUMENTS = dict.fromkeys("frac dfrac tfrac binom dbinom tbinom overset underset".split(), 2) | dict.fromkeys(
    "sqrt mathrm mathbf mathit mathsf mathtt mathcal mathbb mathfrak text operatorname overline underline hat widehat bar vec dot ddot tilde widetilde overbrace underbrace boxed phantom".split(), 1
)
MATH_SYMBOLS = frozenset(
    """alpha beta gamma delta epsilon varepsilon zeta eta theta vartheta iota kappa lambda mu nu xi pi varpi rho varrho sigma varsigma tau upsilon phi varphi chi psi omega
    Gamma Delta Theta Lambda Xi Pi Sigma Upsilon Phi Psi Omega sum prod coprod int iint iiint oint lim min max sup inf sin cos tan cot sec csc arcsin arccos arctan sinh cosh tanh
    log ln exp det gcd Pr dim ker hom arg deg infty partial nabla ell hbar imath jmath Re Im emptyset forall exists neg in notin ni subset supset subseteq supseteq cup cap setminus
    land lor le leq ge geq ne neq approx sim simeq equiv cong propto pm mp times div cdot circ ast star to mapsto rightarrow leftarrow leftrightarrow Rightarrow Leftarrow Leftrightarrow
    uparrow downarrow ldots cdots vdots ddots dots langle rangle lvert rvert lVert rVert vert Vert lbrace rbrace quad qquad limits nolimits
    displaystyle textstyle scriptstyle scriptscriptstyle""".split()
)
MATH_ENVIRONMENTS = frozenset("matrix pmatrix bmatrix Bmatrix vmatrix Vmatrix smallmatrix cases aligned gathered".split())
MATH_DELIMITERS = frozenset([*".()[]|{}", *"langle rangle lvert rvert lVert rVert vert Vert".split()])
MATH_ESCAPES = frozenset(",;:! {}%_&$#")
MOST_FORMULA, MOST_GROUPS, MOST_SCOPES = 65_536, 64, 16


class _Formula:
    """One pass with a stack of what is open: groups, environments and scalable delimiters must close in
    the order they opened in. ``wanted`` holds, per depth, how many braced arguments the last command lacks."""

    def __init__(self, value: str):
        self.parts = [t for t in tokens(value) if not (t[0] == "text" and not t[1].strip())]
        self.open: list[tuple[str, str]] = []
        self.wanted = [0]
        self.i = 0

    def fault(self) -> str | None:
        while self.i < len(self.parts):
            kind, value, _, _ = self.parts[self.i]
            self.i += 1
            if self.wanted[-1] and (kind, value) != ("symbol", "{"):
                return "missing-argument"
            found = getattr(self, f"_{kind}", self._other)(value)
            if found:
                return found
        if self.open:
            return "unbalanced"
        return "missing-argument" if self.wanted[-1] else None

    def _other(self, value: str) -> str | None:
        return None

    def _paragraph(self, value: str) -> str:
        return "paragraph"

    def _text(self, value: str) -> str | None:
        return "not-ascii" if any(ord(c) > 126 for c in value) else None

    def _symbol(self, value: str) -> str | None:
        if value in "$#~" or (value == "&" and not any(k == "environment" for k, _ in self.open)):
            return "bad-symbol"
        if value == "{":
            if self.wanted[-1]:
                self.wanted[-1] -= 1
            self.open.append(("group", ""))
            self.wanted.append(0)
            return "too-deep" if sum(k == "group" for k, _ in self.open) > MOST_GROUPS else None
        if value == "}":
            return self._close("group", "")
        return None

    def _close(self, kind: str, name: str) -> str | None:
        if not self.open or self.open.pop() != (kind, name):
            return "unbalanced"
        return "missing-argument" if self.wanted.pop() else None

    def _command(self, name: str) -> str | None:
        if name in ("begin", "end"):
            inner = [v for _, v, _, _ in self.parts[self.i : self.i + 3]]
            if len(inner) < 3 or inner[0] != "{" or inner[2] != "}" or inner[1] not in MATH_ENVIRONMENTS:
                return "bad-environment"
            self.i += 3
            if name == "end":
                return self._close("environment", inner[1])
            self.open.append(("environment", inner[1]))
            self.wanted.append(0)
            return "too-deep" if sum(k == "environment" for k, _ in self.open) > MOST_SCOPES else None
        if name in ("left", "right"):
            return self._scaled(name)
        if name == "\\":
            return None if any(k == "environment" for k, _ in self.open) else "bad-row"
        if name in MATH_ARGUMENTS:
            if name == "sqrt":
                self._root()
            self.wanted[-1] = MATH_ARGUMENTS[name]
            return None
        return None if name in MATH_SYMBOLS or name in MATH_ESCAPES else f"unknown {name}"

    def _scaled(self, name: str) -> str | None:
        kind, value = self.parts[self.i][:2] if self.i < len(self.parts) else ("", "")
        value = value.lstrip()[:1] if kind == "text" else value
        if value not in MATH_DELIMITERS:
            return "bad-delimiter"
        if kind != "text":
            self.i += 1
        if name == "right":
            return self._close("left", "")
        self.open.append(("left", ""))
        self.wanted.append(0)
        return None

    def _root(self) -> None:
        """Over the optional degree of a root."""
        if self.i < len(self.parts) and self.parts[self.i][1].lstrip().startswith("["):
            while self.i < len(self.parts) and "]" not in self.parts[self.i][1]:
                self.i += 1
            self.i += 1


def math_fault(value: str | None) -> str | None:
    """None for a formula of the known commands, with balanced scopes and all arguments in braces."""
    value = value or ""
    if not value.strip() or len(value) > MOST_FORMULA or "^^" in value or any(ord(c) < 32 and c not in "\n\r\t" or ord(c) == 127 for c in value):
        return "bad-source"
    if re.search(r"(?<!\\)%[^\n]*$", value):
        return "open-comment"
    return _Formula(value).fault()


def check_math(value: Column) -> Column:
    return F.arrow_udf(lambda rows: pa.array([math_fault(v) for v in rows.to_pylist()], pa.string()), "string")(value)
