"""Markup residue in text: find its kinds and turn it into clean text.

1. *Strip.* A scanner knows the residue of HTML, Markdown, wiki and LaTeX. What
   it finds is rewritten so that headings (``# ``), list items (``- ``),
   quotations (``> ``), fenced code and formulas stay recognisable.
2. *Line-block distribution.* Over the stripped lines the lengths of text are
   summed in a sliding window; what stands in links does not count. Where the sum
   surges, text begins; where it dives to nothing, text ends. This decides the kinds
   of a record and the lines of its text.

   Kinds: a page number between like signs (``== 12 ==``, ``*12*``) below the last
   stretch belongs to the page and is no residue; above or within a stretch it is a
   heading or part of the text. Between dashes (``- 12 -``) it is nowhere an item of
   a list. A record has the kinds that are found without such lines.

   Lines: of a text with stretches the lines outside them go: lines that are nothing
   but links, as in menus, and in HTML all lines that are no heading, list item,
   quotation, table, code or formula. A text too short to surge stays as it is, and
   so do the other lines of Markdown, wiki and LaTeX, where a short line between
   blank ones is a caption or a title as often as not.

Signs of the kinds are sought by regular expressions inside the JVM, each behind a
cheap test, so most rows never meet them. Only the texts of rows with signs go to
Python, in Arrow batches: both steps run there, for the kinds and for the text.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from quire.llm.scan_noise import _NUMBER_LINE

#: LaTeX commands that are residue without an argument in braces.
LATEX_BARE = "item|par|noindent|indent|newpage|clearpage|pagebreak|linebreak|newline|ldots|dots|cdots|maketitle|centering|hline|bigskip|medskip|smallskip|hfill|vfill|quad|qquad|footnotemark|footnotetext|textbackslash|LaTeX|TeX|today|leq|geq|neq|sum|frac|times|cdot|alpha|beta|gamma|infty"

#: Letters of scripts without blanks between words, where emphasis may begin and end within a run of letters.
_UNSPACED = "\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"

#: Signs (any of which must occur) and the pattern, by kind. Both Java and Python (_READ) read the patterns.
SIGNS = {
    "html": ["<", "&"],
    "latex": ["\\", "``", "$"],
    "wiki": ["[[", "]]", "{{", "{|", "==", "''", "__", "<ref"],
    "markdown": ["*", "`", "](", "~~", "#", "> ", "---", "===", "_", "- ", "+ ", "<http"],
}
PATTERNS = {
    "html": r"(?i)</?(?!ref\b|nowiki\b|https?:)[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|<!--|<!doctype|&(?:#\d{1,6}|#x[0-9a-f]{1,6}|[a-z]{2,8}\d?);",
    "latex": r"\\(?:(?:" + LATEX_BARE + r")(?![a-zA-Z])|[a-zA-Z]+\*?\{|\\(?=\s|\[|$)|\(|[%&])|\\\[(?=[^\]]*\\\])|\{\\[a-zA-Z]{2,12}(?![a-zA-Z])|(?<!`)``(?![`\s])|\$[^$\n]*[\\^_{}][^$\n]*\$",
    "wiki": r"(?m)\[\[|\{\{|\{\||^={2,6} ?[^=\n]+?={2,6}[ \t\r]*$|(?<!')'{2,5}(?=[\p{L}\p{N}“„«])[^'`\n]*(?:'[^'`\n]+)*'{2,5}|__[A-Z]{3,}__|<ref[ >/]|</ref>|<nowiki",
    "markdown": r"(?m)^ {0,3}#{1,6} \S|^ {0,3}> ?\S|^ {0,3}(?:`{3}|~{3})|^ {0,3}(?:={3,}|-{3,})[ \t\r]*$|!?\[[^\]\n]*\]\([^)\n]+\)|\*\*(?=\S)[^*\n]+\*\*|(?<![`\\])`[^`\n]+`(?!`)|(?<!\*)\*(?=[^\s*])[^*\n]*(?<=[^\s*])\*(?!\*)|(?<![\p{L}\p{N}_/.])__?(?=[^\s_])[^_\n]+(?<=[^\s_])__?(?![\p{L}\p{N}_]|\.[\p{L}\p{N}_])|(?:(?<![\p{L}\p{N}_/.])|(?<=[" + _UNSPACED + r"]))__(?=[^\s_])[^_\n]+(?<=[^\s_])__(?:(?![\p{L}\p{N}_]|\.[\p{L}\p{N}_])|(?=[" + _UNSPACED + r"]))|~~(?=\S)[^~\n]+~~|^ {0,3}[-*+] \S[^\n]*\n(?:\s*\n)? {0,3}[-*+] \S|^\|(?: ?:?-{3,}:? ?\|)+|^\[(?!\^fn-)[^\]\n]+\]: \S|<https?://[^>\s]+>",
}
KINDS = tuple(PATTERNS)
_READ = {k: re.compile(p.replace(r"\p{L}\p{N}_", r"\w").replace(r"\p{L}\p{N}", r"\w")) for k, p in PATTERNS.items()}


def _has(text: Column, signs: list[str]) -> Column:
    test = text.contains(signs[0])
    for s in signs[1:]:
        test = test | text.contains(s)
    return test


def markup_signs(text: Column) -> Column:
    """The kinds of markup of which a text has signs, as an array of strings; empty for null."""
    found = [F.when(_has(text, SIGNS[k]) & text.rlike(PATTERNS[k]), F.lit(k)) for k in KINDS]
    return F.array_compact(F.array(*found))


_TAG_BREAK = re.compile(r"(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6]|blockquote|ul|ol|table|section|figure|figcaption)>|<(?:p|div|ul|ol|table|section|figure)(?:\s[^<>]*)?>")
_TAG = re.compile(r"(?i)</?[a-z][a-z0-9]*(?:\s[^<>]*)?/?>|<!doctype[^>]*>")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]+\)")
_MATH = re.compile(r"\$\$.+?\$\$|\$[^$\n]*[\\^_{}][^$\n]*\$|\\\(.+?\\\)|\\\[.+?\\\]", re.S)
_FENCE = re.compile(r"(?ms)^ {0,3}(`{3,}|~{3,})[^\n]*\n.*?^ {0,3}\1[ \t]*$")
_STRONG = re.compile(rf"(?:(?<![\w/.])|(?<=[{_UNSPACED}]))__(?=[^\s_])([^_\n]*[^\s_])__(?:(?!\w|\.\w)|(?=[{_UNSPACED}]))")
_SECTION = re.compile(r"\\(chapter|section|subsection|subsubsection|paragraph)\*?\{([^{}]*)\}")
_DEPTH = {"chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5}


def _html(t: str) -> str:
    t = re.sub(r"(?s)<!--.*?-->", " ", t)
    t = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", " ", t)
    t = re.sub(r"(?is)<pre\b[^>]*>(.*?)</pre>", lambda m: f"\n```\n{m[1].strip()}\n```\n", t)
    t = re.sub(r"(?i)<h([1-6])\b[^>]*>", lambda m: "\n" + "#" * int(m[1]) + " ", t)
    t = re.sub(r"(?i)<li\b[^>]*>", "\n- ", t)
    t = re.sub(r"(?i)<blockquote\b[^>]*>", "\n> ", t)
    t = re.sub(r"(?i)<code\b[^>]*>([^<]*)</code>", r"`\1`", t)
    t = re.sub(r"(?i)</t[dh]>\s*(?=<t[dh])", " | ", t)
    t = _TAG.sub("", _TAG_BREAK.sub("\n", t))
    once = html.unescape(t)
    return _TAG.sub("", _TAG_BREAK.sub("\n", once)) if once != t else t


def _latex(t: str) -> str:
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    t = _MATH.sub(keep, t)
    t = _SECTION.sub(lambda m: "\n" + "#" * _DEPTH[m[1]] + f" {m[2]}\n", t)
    t = re.sub(r"\\begin\{(?:quote|quotation)\}\s*(.*?)\s*\\end\{(?:quote|quotation)\}", lambda m: "\n> " + m[1].replace("\n", "\n> ") + "\n", t, flags=re.S)
    t = re.sub(r"\\begin\{verbatim\}\n?(.*?)\n?\\end\{verbatim\}", r"\n```\n\1\n```\n", t, flags=re.S)
    t = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "\n", t)
    t = re.sub(r"[ \t]*\\item(?:\[[^\]]*\])?\s*", "\n- ", t)
    t = re.sub(r"~?\\(?:cite[a-z]*|label|ref|eqref|index|pageref)\*?(?:\[[^\]]*\])*\{[^{}]*\}", "", t)
    t = re.sub(r"\\footnote(?:text)?\{([^{}]*)\}", r" (\1)", t)
    t = re.sub(r"\\footnotemark(?:\[[^\]]*\])?", "", t)
    for _ in range(4):
        t, n = re.subn(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"\1", t)
        if not n:
            break
    t = re.sub(r"\{\\[a-zA-Z]{2,12}(?![a-zA-Z])\s*([^{}]*)\}", r"\1", t)
    t = re.sub(r"\\(?:ldots|dots)\b", "…", t)
    t = re.sub(r"\\(?:" + LATEX_BARE + r")(?![a-zA-Z])", " ", t)
    t = re.sub(r"\\\\(?:\[[^\]]*\])?(?=\s|$)", "\n", t)
    t = re.sub(r"\\([%&#_$])", r"\1", t)
    t = re.sub(r"(?<!`)``(?![`\s])(.*?)(?:''|$)", r"“\1”", t, flags=re.S)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], t)


def _wiki(t: str) -> str:
    def table(m: re.Match) -> str:
        rows = []
        for line in m[1].split("\n"):
            line = line.strip()
            if line[:1] in "|!" and line[:2] not in ("|-", "|+", "|}"):
                rows.append(" | ".join(x.strip() for x in re.split(r"\|\||!!", line[1:])))
        return "\n".join(rows)

    t = re.sub(r"(?s)\{\|[^\n]*\n?(.*?)\|\}", table, t)
    t = re.sub(r"(?is)<ref[^>/]*/>|<ref[^>]*>.*?</ref>|</?nowiki/?>", "", t)
    t = re.sub(r"(?m)^(={2,6}) ?([^=\n]+?) ?={2,6}[ \t\r]*$", lambda m: "#" * len(m[1]) + " " + m[2], t)
    for _ in range(3):
        t, n = re.subn(r"\{\{[^{}]*\}\}", "", t)
        if not n:
            break
    t = re.sub(r"(?m)^[ \t]*\[\[(?i:category|kategorie|catégorie):[^\]\n]*\]\][ \t]*\n?", "", t)
    t = re.sub(r"\[\[(?i:file|image|datei|fichier):[^\]\n]*?(?:\|([^|\]\n]*))?\]\]", lambda m: m[1] or "", t)
    t = re.sub(r"\[\[(?:[^\]|\n]*\|)?([^\]|\n]*)\]\]", r"\1", t)
    t = re.sub(r"__[A-Z]{3,}__", "", t)
    return re.sub(r"(?<!')('{2,5})(?=[^\s'])((?:[^'`\n]|'(?!'))+)'{2,5}", r"\2", t)


def _markdown(t: str) -> str:
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    t = _FENCE.sub(keep, t)
    t = re.sub(r"(?m)^([^\n]+)\n {0,3}(={3,}|-{3,})[ \t\r]*$", lambda m: ("# " if m[2][0] == "=" else "## ") + m[1], t)
    t = re.sub(r"(?m)^ {0,3}-{3,}[ \t\r]*$\n?", "", t)
    t = re.sub(r"(?m)^\|(?: ?:?-{3,}:? ?\|)+[ \t]*\n?", "", t)
    t = _LINK.sub(r"\1", t)
    t = re.sub(r"<(https?://[^>\s]+)>", r"\1", t)
    t = re.sub(r"(\*{1,3})(?=[^\s*])([^*\n]*[^\s*])\1", r"\2", t)
    t = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", t)
    t = _STRONG.sub(r"\1", t)
    t = re.sub(r"(?<![\w/.])_(?=[^\s_])([^_\n]*[^\s_])_(?!\w|\.\w)", r"\1", t)
    t = re.sub(r"(?m)^( {0,3})[*+] (?=\S)", r"\1- ", t)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], t)


#: Around the text of a link while a record is rewritten.
_OPEN, _CLOSE = "\x01", "\x02"
_ANCHOR = re.compile(r"(?is)(<a\b[^<>]*>)(.*?)(</a\s*>)")
_WIKI_LINK = re.compile(r"\[\[(?!(?:file|image|datei|fichier|category|kategorie|catégorie):)((?:[^\]|\n]*\|)?)([^\]|\n]*)\]\]", re.I)
_STRUCTURE = re.compile(r"(?:#{1,6} |- |> |\d{1,3}[.)] |\||```|\$|\\[\[(])|.* \| ")


def _marked_links(t: str, kinds: list[str]) -> str:
    if "html" in kinds:
        t = _ANCHOR.sub(lambda m: f"{m[1]}{_OPEN}{m[2]}{_CLOSE}{m[3]}", t)
    if "wiki" in kinds:
        t = _WIKI_LINK.sub(lambda m: f"[[{m[1]}{_OPEN}{m[2]}{_CLOSE}]]", t)
    if "markdown" in kinds:
        t = re.sub(r"(?<!!)\[([^\]\n^][^\]\n]*)\](\([^)\n]+\))", lambda m: f"[{_OPEN}{m[1]}{_CLOSE}]{m[2]}", t)
    return t


_REWRITE = {"html": _html, "latex": _latex, "wiki": _wiki, "markdown": _markdown}


def line_blocks(lengths: list[int], window: int = 3, surge: int = 40) -> list[bool]:
    """Which lines lie in text, by the distribution of summed line lengths.

    A stretch begins where the sum over ``window`` lines reaches ``surge`` and
    ends where it dives to nothing; it starts at the first and ends at the last
    line with text in the windows concerned.
    """
    n = len(lengths)
    inside = [False] * n
    sums = [sum(lengths[i : i + window]) for i in range(n)]
    i = 0
    while i < n:
        if sums[i] < surge:
            i += 1
            continue
        while i < n and not lengths[i]:
            i += 1
        start = i
        while i < n and sums[i] > 0:
            i += 1
        for j in range(start, i):
            inside[j] = True
    return inside


#: In place of a line with a page number while a record is rewritten.
_SET, _OFF = "\x03", "\x04"
_SET_OFF = re.compile(f"{_SET}(\\d+){_OFF}")
#: Signs that stand on both sides of a page number.
_DASH_SIGNS = "-–—"
_NUMBER_SIGNS = _DASH_SIGNS + "=*_~"


def number_signs(line: str) -> str:
    """The signs on either side of a line that is a page number between like signs, else nothing."""
    line = line.strip()
    core = line.strip(_NUMBER_SIGNS + " \t")
    left, right = line[: line.find(core)], line[line.find(core) + len(core) :]
    return left.strip() if core and left == right[::-1] and _NUMBER_LINE.match(core) else ""


def _stripped(t: str, kinds: list[str]) -> list[str]:
    """Lines of a text without the residue of the given kinds; texts of links stand between _OPEN and _CLOSE."""
    if "markdown" in kinds and "latex" in kinds:
        order = ("html", "wiki", "markdown", "latex")
    else:
        order = ("html", "wiki", "latex", "markdown")
    if _OPEN not in t and _CLOSE not in t:
        t = _marked_links(t, kinds)
    for k in order:
        if k in kinds:
            t = _REWRITE[k](t)
    return [re.sub(r"[ \t]+", " ", x).strip() if not x.startswith("    ") else x.rstrip() for x in t.split("\n")]


def _distributed(t: str, kinds: list[str], window: int, surge: int) -> tuple[list[str], list[int], list[bool]]:
    """The stripped lines of a text, what each of them tells in letters, and which lie in text."""
    lines = _stripped(t, kinds)
    plain = [_SET_OFF.sub("", re.sub(f"{_OPEN}[^{_CLOSE}]*{_CLOSE}", "", x)) for x in lines]
    told = [len(re.sub(r"[\W_]+", "", x)) for x in plain]
    return [x.replace(_OPEN, "").replace(_CLOSE, "") for x in lines], told, line_blocks(told, window, surge)


def _page_numbers(signs: dict[int, str], lines: list[str], inside: list[bool]) -> set[int]:
    """Those lines with a number between signs, named by their place in the record, that are page numbers."""
    last = max((i for i, x in enumerate(inside) if x), default=len(lines))
    fenced = _fenced(lines)
    alone = {int(m[1]): i for i, x in enumerate(lines) if (m := _SET_OFF.fullmatch(x)) and not fenced[i]}
    return {n for n, i in alone.items() if i > last or not signs[n].strip(_DASH_SIGNS)}


def residue(text: str, kinds: list[str], window: int = 3, surge: int = 40) -> tuple[list[str], str]:
    """Of the kinds a text has signs of, those it has residue of, and the text without it."""
    raw_lines = text.replace("\r\n", "\n").split("\n")
    signs = {} if _SET in text or _OFF in text else {i: s for i, x in enumerate(raw_lines) if (s := number_signs(x))}

    def without(numbers: set[int] | dict[int, str]) -> str:
        return "\n".join(f"{_SET}{i}{_OFF}" if i in numbers else x for i, x in enumerate(raw_lines))

    lines, told, inside = _distributed(without(signs), kinds, window, surge)
    if signs:
        numbers = _page_numbers(signs, lines, inside)
        left = _SET_OFF.sub("", without(numbers))
        true = [k for k in kinds if _READ[k].search(left) or not _READ[k].search(without(set()))]
        if len(true) < len(kinds) and not true:
            return true, text
        kinds = true
        lines, told, inside = _distributed(without(numbers), kinds, window, surge)
    letters = [len(re.sub(r"[\W_]+", "", x)) for x in lines]
    page = "html" in kinds
    fenced = _fenced(lines)
    raw = set(x.strip() for x in raw_lines)

    def stays(i: int) -> bool:
        if inside[i] or fenced[i] or _SET_OFF.search(lines[i]) and signs:
            return True
        if not letters[i]:
            # a line without words that was there before stripping
            return bool(lines[i]) and lines[i] in raw
        if not any(inside):
            return True
        return bool(told[i]) and (not page or _STRUCTURE.match(lines[i]) is not None)

    out = [_SET_OFF.sub(lambda m: raw_lines[int(m[1])].strip(), x) if signs else x for i, x in enumerate(lines) if stays(i)]
    return kinds, re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def clean(text: str, kinds: list[str], window: int = 3, surge: int = 40) -> str:
    """One text without the residue of the given kinds."""
    return residue(text, kinds, window, surge)[1]


def _fenced(lines: list[str]) -> list[bool]:
    """Which lines are fenced code, fences included."""
    out, fence = [], None
    for x in lines:
        m = re.match(r"`{3,}|~{3,}", x.strip())
        out.append(fence is not None or m is not None)
        if m and fence is None:
            fence = m.group()
        elif m and x.strip() == fence:
            fence = None
    return out


_RESIDUE = StructType([StructField("kinds", ArrayType(StringType())), StructField("text", StringType())])


def _judged(text: Column, signs: Column, with_text: bool, window: int, surge: int) -> Column:
    """residue() of texts with signs as a struct of kinds and text; null for other texts, which don't go to Python."""

    def run(s: pd.Series, k: pd.Series) -> pd.DataFrame:
        got = [(None, None) if x is None else residue(x, list(y), window, surge) for x, y in zip(s, k)]
        return pd.DataFrame({"kinds": pd.Series([a for a, _ in got], dtype=object), "text": pd.Series([b if with_text else None for _, b in got], dtype=object)})

    dirty = F.size(signs) > 0
    return F.pandas_udf(run, _RESIDUE)(F.when(dirty, text), F.when(dirty, signs))


def markup_residue(records: DataFrame, text_col: str = "text", skip: Column | None = None, with_text: bool = True, window: int = 3, surge: int = 40) -> DataFrame:
    """records with markup_kinds (array of html, markdown, wiki, latex) and, if wanted, clean_text.

    Null texts have no kinds and stay null; rows where skip is true count as free
    of residue. Repeated rows are kept. Columns of these names are replaced.
    """
    signs = markup_signs(F.col(text_col))
    if skip is not None:
        signs = F.when(F.coalesce(skip, F.lit(False)), F.array().cast("array<string>")).otherwise(signs)
    signed = records.withColumn("_signs", signs)
    judged = signed.withColumn("_residue", _judged(F.col(text_col), F.col("_signs"), with_text, window, surge))
    none = F.array().cast("array<string>")
    out = judged.withColumn("markup_kinds", F.coalesce("_residue.kinds", none))
    if with_text:
        out = out.withColumn("clean_text", F.when(F.size("markup_kinds") > 0, F.col("_residue.text")).otherwise(F.col(text_col)))
    return out.drop("_signs", "_residue")
