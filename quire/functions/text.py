"""String expressions. All are built from Spark's own functions, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What typography becomes, one character for another.
DASHES_AND_QUOTES = ("\u2014\u2013\u2018\u2019\u201c\u201d\u00ab\u00bb", "--''\"\"\"\"")
#: LaTeX specials in an order that never escapes what an earlier step has written.
LATEX_SPECIALS = (("{", r"\{"), ("}", r"\}"), ("$", r"\$"), ("&", r"\&"), ("#", r"\#"), ("_", r"\_"), ("%", r"\%"), ("[", r"\["), ("]", r"\]"), ("^", r"\^{}"), ("~", r"\~{}"))
#: Characters that file names can't hold, and names that one system reserves.
ILLEGAL_IN_NAMES = '<>:"/\\|?*'
RESERVED_NAMES = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
_MARK = "\x00"


def normalize_newlines(text: Column) -> Column:
    """CRLF and lone CR to LF."""
    return F.regexp_replace(text, "\r\n|\r", "\n")


def separators(text: Column) -> Column:
    """The line separators of a text in their order."""
    return F.regexp_extract_all(text, F.lit("\r\n|\r|\n"), 0)


def newline_counts(text: Column) -> dict[str, Column]:
    """Counts of CRLF, lone CR, lone LF."""
    crlf = F.regexp_count(text, F.lit("\r\n"))
    return {
        "n_crlf": crlf.cast("long"),
        "n_cr": (F.regexp_count(text, F.lit("\r")) - crlf).cast("long"),
        "n_lf": (F.regexp_count(text, F.lit("\n")) - crlf).cast("long"),
    }


def restore_newlines(text: Column, seps: Column) -> Column:
    """Put recorded separators back between the LF-split lines; where their number is not that of the LFs,
    the text keeps its LFs."""
    lines = F.split(text, "\n", -1)
    joined = F.array_join(F.zip_with(lines, F.array_append(seps, F.lit("")), lambda a, b: F.concat(a, b)), "")
    return F.when(F.size(seps) == F.size(lines) - 1, joined).otherwise(text)


def fix_typography(text: Column) -> tuple[Column, Column]:
    """(text with straight quotes, hyphens and three dots; how many characters were replaced)."""
    of, to = DASHES_AND_QUOTES
    n = F.length(text) - F.length(F.translate(text, of + "\u2026", ""))
    return F.replace(F.translate(text, of, to), F.lit("\u2026"), F.lit("...")), n.cast("long")


def escape_latex(text: Column) -> Column:
    """Escape the specials; a backslash waits on a mark until all others are done."""
    out = F.replace(text, F.lit("\\"), F.lit(_MARK))
    for a, b in LATEX_SPECIALS:
        out = F.replace(out, F.lit(a), F.lit(b))
    out = F.replace(out, F.lit(_MARK), F.lit(r"\textbackslash{}"))
    return F.replace(out, F.lit("\u2026"), F.lit(r"\dots{}"))


def _quoted(c: str) -> str:
    return f"\\Q{c}\\E" if c else ""


def sanitize_filename(name: Column, replacement: str = "_") -> Column:
    """Illegal characters become ``replacement``, its runs collapse, and it goes from the ends, with blanks."""
    if len(replacement) != 1 or replacement in ILLEGAL_IN_NAMES:
        raise ValueError("a replacement is one legal character")
    out = F.translate(name, ILLEGAL_IN_NAMES, replacement * len(ILLEGAL_IN_NAMES))
    out = F.regexp_replace(out, f"{_quoted(replacement)}+", replacement if replacement not in "$\\" else f"\\{replacement}")
    return F.btrim(out, F.lit(replacement + " "))


def safe_artifact_name(name: Column, fallback: str = "artifact", limit: int = 160) -> Column:
    """The last path element without control characters; reserved names get an underscore in front; at
    most ``limit`` characters; ``fallback`` where nothing is left."""
    base = F.element_at(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1), -1)
    base = F.btrim(F.regexp_replace(base, "[\\x00-\\x1f\\x7f]", ""), F.lit(". "))
    base = F.translate(base, ILLEGAL_IN_NAMES, "_" * len(ILLEGAL_IN_NAMES))
    stem = F.upper(F.element_at(F.split(base, "\\.", -1), 1))
    base = F.when(stem.isin(*RESERVED_NAMES), F.concat(F.lit("_"), base)).otherwise(base)
    base = F.substring(base, 1, limit)
    return F.when(F.coalesce(base, F.lit("")) == "", F.lit(fallback)).otherwise(base)


def squeeze(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def repeat_key(text: Column) -> Column:
    """What running headers have in common: squeezed, lower-cased, whole numbers as ``#``. The fold is
    ``lower``: of characters with longer folds, such as the sharp s, the case is kept."""
    return F.regexp_replace(F.lower(squeeze(text)), "(?U)\\b\\d+\\b", "#")


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def css_string(text: Column) -> Column:
    """A quoted CSS string; quotes and backslashes are escaped, line ends become ``\\a``."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.regexp_replace(out, "\n", "\\\\\\\\a "), F.lit('"'))


def css_identifier(text: Column) -> Column:
    """Only letters, digits, ``_`` and ``-``; a leading digit gets an underscore."""
    out = F.regexp_replace(text, "[^A-Za-z0-9_-]+", "-")
    return F.when(out.rlike("^[A-Za-z_]"), out).otherwise(F.concat(F.lit("_"), out))


def safe_id(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9_]", "_")


def bookmark_name(identifier: Column) -> Column:
    """A stable name from an id: a letter and 20 digits of its digest."""
    return F.concat(F.lit("b"), F.substring(F.sha2(identifier.cast("binary"), 256), 1, 20))


def font_family_key(name: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]", "")


def font_class(name: Column) -> Column:
    """mono, serif or sans, by what the family's name says; sans where it says nothing."""
    key = F.lower(name)
    mono = key.rlike("mono|courier|consol|typewriter|code")
    sans = key.rlike("sans|arial|helvet|calibri|verdana|tahoma|segoe")
    serif = key.rlike("serif|times|georgia|garamond|cambria|palatino|roman|book")
    return F.when(mono, "mono").when(sans, "sans").when(serif, "serif").otherwise("sans")


def allowed_link(href: Column) -> Column:
    """Fragments, http, https and mailto; anything else is null."""
    scheme = F.lower(F.regexp_extract(href, "^\\s*([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(F.startswith(href, F.lit("#")) | scheme.isin("http", "https", "mailto"), href)


def relationship_owner(name: Column) -> Column:
    """``/a/_rels/b.rels`` belongs to ``/a/b``; the package's own to ``/``; null for other names."""
    found = F.regexp_replace(name, "^(.*/)_rels/([^/]*)\\.rels$", "$1$2")
    return F.when(name.rlike("/_rels/[^/]*\\.rels$"), found)


def is_part_name(name: Column) -> Column:
    """Absolute, no empty, dot or dot-dot segment, no query, no fragment, no backslash."""
    return name.rlike("^(/(?!\\.{1,2}(/|$))[^/?#\\\\]+)+$")


def count_pattern(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def latex_metrics(raw: Column) -> dict[str, Column]:
    """Counts of a LaTeX source: headings, tables, images, links, references, citations, formulas, items."""
    body = F.regexp_replace(raw, "(?m)(^|[^\\\\])%[^\n]*", "$1")
    one = lambda p: count_pattern(body, p)
    display = one(r"\\\[") + one(r"\$\$[^$]+\$\$")
    inline = count_pattern(F.regexp_replace(body, r"\$\$[^$]+\$\$", ""), r"\$[^$\n]+\$") + one(r"\\\(")
    return {
        "n_headings": one(r"\\(part|chapter|section|subsection|subsubsection|paragraph|subparagraph)\*?\s*[\[{]"),
        "n_tables": one(r"\\begin\s*\{(tabular|longtable|tabularx)\*?\}"),
        "n_images": one(r"\\includegraphics\b"),
        "n_links": one(r"\\(href|url)\b"),
        "n_refs": one(r"\\(ref|eqref|pageref|autoref)\b"),
        "n_citations": one(r"\\cite[a-z]*\b"),
        "n_formulas": display + inline + one(r"\\begin\s*\{(equation|align|gather|multline)\*?\}"),
        "n_items": one(r"\\item\b"),
    }


def latex_paragraphs(raw: Column) -> Column:
    """Blocks between blank lines that have a word character."""
    blocks = F.split(normalize_newlines(raw), "\n[ \t]*\n", -1)
    return F.size(F.filter(blocks, lambda b: b.rlike("[\\p{L}\\p{N}_]"))).cast("long")


#: Paper sizes in points by a class option, and environments that hold mathematics.
PAPER_SIZES = {"a3paper": (841.89, 1190.55), "a4paper": (595.28, 841.89), "a5paper": (419.53, 595.28), "letterpaper": (612.0, 792.0), "legalpaper": (612.0, 1008.0)}
MATH_ENVIRONMENTS = ("equation", "equation*", "align", "align*", "gather", "gather*", "alignat", "alignat*", "eqnarray", "eqnarray*", "multline", "multline*")
_DISPLAY = r"(?s)\$\$.*?\$\$|\\\[.*?\\\]"
_INLINE = r"(?<!\\)\$(?!\$)[^$\n]+(?<!\\)\$"


def class_options(raw: Column) -> Column:
    """The options of a LaTeX source's document class, trimmed; none where it has no class or no options."""
    inside = F.regexp_extract(raw, r"\\documentclass\s*\[([^\]]*)\]\s*\{[^{}]*\}", 1)
    return F.filter(F.transform(F.split(inside, ",", -1), lambda o: F.trim(o)), lambda o: o != "")


def latex_paper_size(raw: Column) -> Column:
    """struct(width, height) in points of the first known paper that the document class names; null without one."""
    head = F.regexp_extract(raw, r"(\\documentclass\s*(?:\[[^\]]*\])?\s*\{[^{}]*\})", 1)
    out = F.lit(None).cast("struct<width:double,height:double>")
    for name, (w, h) in reversed(PAPER_SIZES.items()):
        out = F.when(F.contains(head, F.lit(name)), F.struct(F.lit(w).alias("width"), F.lit(h).alias("height"))).otherwise(out)
    return out


def latex_formulas(raw: Column) -> Column:
    """How many formulas a LaTeX source has: displayed, inline, and environments of mathematics."""
    begins = "|".join(e.replace("*", r"\*") for e in MATH_ENVIRONMENTS)
    return (F.regexp_count(raw, F.lit(_DISPLAY)) + F.regexp_count(raw, F.lit(_INLINE)) + F.regexp_count(raw, F.lit(rf"\\begin\{{(?:{begins})\}}"))).cast("long")


def strip_latex(raw: Column) -> Column:
    """The words of a LaTeX source: without comments, mathematics, references and commands; what formatting
    commands and links hold stays."""
    begins = "|".join(e.replace("*", r"\*") for e in MATH_ENVIRONMENTS)
    t = F.regexp_replace(raw, r"(?m)(?<!\\)%.*$", "")
    for pattern, by in (
        (_DISPLAY, " "), (rf"(?s)\\begin\{{({begins})\}}.*?\\end\{{\1\}}", " "), (_INLINE, " "), (r"\\href\{[^{}]*\}\{([^{}]*)\}", "$1"), (r"\\[a-zA-Z@]*cite[a-zA-Z@]*\{", " "),
        (r"\\(?:eqref|pageref|cref|vref|label|ref)\{", " "), (r"\\(?:begin|end)\{[a-zA-Z*]+\}", " "), (r"\\(?:textbf|textit|emph|text|mbox|mathrm|mathsf|mathtt|mathcal|underline|url)\{([^{}]*)\}", "$1"), (r"\\[a-zA-Z@]+\*?", " "),
    ):
        t = F.regexp_replace(t, pattern, by)
    for c in "%&_#${}":
        t = F.replace(t, F.lit("\\" + c), F.lit(c))
    return F.trim(F.regexp_replace(F.translate(t, "~{}", "   "), r"(?U)\s+", " "))
