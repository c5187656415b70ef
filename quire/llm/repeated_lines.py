"""Lines repeated across the pages of one source.

Lines become templates through token trees of fixed depth. A line is folded (case,
blanks, punctuation, attached page numbers, accents); as blanks may differ between
printings of one line, its tokens are runs of letters of the folded form: one at its
start, one at its end and, in long forms, one in the middle. A path of the tree is
source, place of the token, token; all else of the line is the wildcard slot of that
leaf. No letter or two misread or lost can touch all tokens of a form, so every
printing of a line within that reach shares a leaf with its plain form.

1. *Trees of the parts.* Lines of one source and stretch of pages build a tree. A
   leaf counts the pages of all forms in it, which bounds from above the pages on
   which any one of them, damaged printings included, can stand. Forms whose leaves
   reach their stretch's share of the pages needed leave it as templates.
2. *Merge.* Templates merge by source and form; their bounds add up, a stretch that did not
   report one counting for the little it may still have. What cannot reach the
   needed pages goes, so the number of templates of a source follows the lines of
   a page and not the size of the source.
3. *Match.* The merged templates go back to each stretch as a tree of their
   source; each line walks its own paths only, and the slot is tested to differ by
   a letter or two, or by one letter read as two. The plain form of a template is on
   two pages at least and on more than any damaged one. Pages of a template are
   then counted exactly, over distinct pages.

A stretch bounds the rows of one group, so a source with a third of all rows is
spread over its stretches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.fold import ACCENTED, PLAIN
from quire.runtime import cut, cut_bucketed, release

#: Most letters of a token; pages of a stretch.
TOKEN, STRETCH = 8, 256
#: Forms from this length on may differ by two letters, shorter ones by one or by these pairs of letters read for one.
LONG_FORM = 24
READ_AS = [("rn", "m"), ("nn", "m"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("ri", "n"), ("lc", "k")]
#: Stretches of a longer source report a template from this part of their share of the needed pages on.
REPORTED = 1 / 8
#: Words before a page number.
PAGE_WORDS = "pages?|pag|pp?|seiten?|s|folio|fol|f|blatt|bl|feuillet|leaf|no|nr|n|page n"
_ROMAN = "[ivxlcdm]+"
_NUMBER = rf"(?:\d+|{_ROMAN})"
_ONLY_NUMBER = re.compile(rf"[\W_]*(?:(?:{PAGE_WORDS})(?![^\W\d_])[\W_]*)?{_NUMBER}(?:[\W_]+(?:of|von|sur|de|aus)?[\W_]*{_NUMBER})?[\W_]*$")
_ATTACHED = rf"(?:(?:{PAGE_WORDS})[. ]{{1,2}})?(?:\d+[*†]?|{_ROMAN}(?=[\s\])|·—–:-]|\.\s|$))"
_AT_START = re.compile(rf"[\W_]*{_ATTACHED}(?=[\W\d_]|$)")
_AT_END = re.compile(rf"(?<![^\W_]){_ATTACHED}[\W_]*$")
_LETTERS = re.compile(r"[^\W\d_]+")
_ROMAN_LETTERS = "ivxlcdm"
_NUMBER_STARTS = _ROMAN_LETTERS + "".join(sorted({w[0] for w in PAGE_WORDS.split("|")}))
_FOLD = str.maketrans(ACCENTED + "ß", PLAIN + "s")
_TAIL = 32
_MARKS = " \t\r\u00a0\u2002\u2003\u2009\u3000!\"#%&'()*+,-./:;<=>?@[]^_`{|}~§°·†‡•–—―…«»‘’“”„"


def is_page_number(line: str) -> bool:
    """Whether a line is nothing but a page number, in any style."""
    return bool(_ONLY_NUMBER.match(line.lower()))


def line_form(line: str) -> str | None:
    """The folded form of a line; None where no letters are left or the line is only a page number."""
    low = line.lower()
    first = low[:1]
    # most lines open and close with letters that no number and no word before one has there
    if not first.isalpha() or first in _NUMBER_STARTS:
        if _ONLY_NUMBER.match(low):
            return None
        if m := _AT_START.match(low):
            low = low[m.end() :]
    bare = low.rstrip(_MARKS)
    if not bare[-1:].isalpha() or bare[-1] in _ROMAN_LETTERS:
        # the longest number with its word has fewer signs than this; marks behind it do not count
        if m := _AT_END.search(low, max(0, len(bare) - _TAIL)):
            low = low[: m.start()]
    form = "".join(_LETTERS.findall(low))
    if not form.isascii():
        form = form.translate(_FOLD)
    return form if len(form) > 1 else None


def lines_of(blocks: DataFrame, source: str, page: str, key: str, content: str, stretch: int = STRETCH) -> DataFrame:
    """source, stretch, page, block_id, line_no, form of every line with a form; lines end with LF or CRLF."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, no, form = [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                for k, line in enumerate(text.split("\n")):
                    if f := line_form(line):
                        of.append(i)
                        no.append(k)
                        form.append(f)
            rows = pa.array(of, pa.int32())
            at = b.column(1).take(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), pc.floor(pc.divide(at.cast(pa.float64()), float(stretch))).cast(pa.int64()), at, b.column(2).take(rows), pa.array(no, pa.int32()), pa.array(form, pa.string())],
                ["source", "stretch", "page", "block_id", "line_no", "form"],
            )

    rows = blocks.where(F.col(content).isNotNull()).select(F.col(source).cast("string"), F.col(page).cast("long"), F.col(key).cast("string"), F.col(content))
    return rows.mapInArrow(split, "source string, stretch long, page long, block_id string, line_no int, form string")


def paths(form: str) -> list[str]:
    """Paths of a form below its source: place and token; the rest of the form is the wildcard slot."""
    n = len(form)
    out = []
    # half of the shorter of two forms that differ in length by one
    for k in {min(TOKEN, n // 2), min(TOKEN, (n - 1) // 2)} - {0}:
        out += ["<" + form[:k], ">" + form[-k:]]
    if n >= LONG_FORM - 2:
        # a letter lost or won before the middle token moves it by one
        out += ["|" + form[k : k + TOKEN] for k in (TOKEN - 1, TOKEN, TOKEN + 1)]
    return out


def template_paths(form: str) -> list[str]:
    """Paths under which a template stands: those of its form, with the middle token where it is."""
    return [x for x in paths(form) if x[0] != "|"] + (["|" + form[TOKEN : 2 * TOKEN]] if len(form) >= LONG_FORM else [])


def within(a: str, b: str, edits: int) -> bool:
    """Whether two strings differ by at most so many letters misread, lost or won."""
    if abs(len(a) - len(b)) > edits:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if not edits or i == n:
        return len(a) == len(b) == i or len(a) + len(b) - 2 * i <= edits
    a, b = a[i:], b[i:]
    return within(a[1:], b[1:], edits - 1) or within(a[1:], b, edits - 1) or within(a, b[1:], edits - 1)


def same_line(form: str, template: str) -> bool:
    """Whether the slot between a form and a template is a letter or two, or one letter read as two."""
    if form == template or within(form, template, 2 if len(template) >= LONG_FORM else 1):
        return True
    if len(template) >= LONG_FORM or not within(form, template, 2):
        return False
    return any(form.replace(two, one) == template.replace(two, one) for two, one in READ_AS)


class TokenTree:
    """Leaves of one source by path."""

    def __init__(self) -> None:
        self.leaves: dict[str, list[tuple[int, str]]] = {}

    def add(self, form: str, n: int, under: list[str]) -> None:
        for path in under:
            self.leaves.setdefault(path, []).append((n, form))

    def match(self, form: str, pages: int = 0) -> str | None:
        """The most printed template of which a form is a printing; what is damaged is on fewer pages than what it was."""
        met = {t for path in paths(form) for t in self.leaves.get(path, ())}
        return next((t for n, t in sorted(met, reverse=True) if form == t or n > pages and same_line(form, t)), None)


def _page_counts(lines: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The forms in order and their distinct pages."""
    once = lines.group_by(["form", "page"]).aggregate([]).group_by("form").aggregate([([], "count_all")]).sort_by("form")
    return once.column("form").combine_chunks(), once.column("count_all").to_numpy()


def _short(forms: pa.Array) -> np.ndarray:
    """Which forms have tokens of less than full length; the others are handled by columns."""
    return np.asarray(pc.less_equal(pc.utf8_length(forms), 2 * TOKEN))


def _tokens(forms: pa.Array, at: int, stop: int | None) -> pa.Array:
    return pc.utf8_slice_codeunits(forms, at, stop)


def frequent(forms: pa.Array, pages: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(places of forms, their bounds): forms that may, with their damaged printings, be on at least so many pages.

    forms are in order. A leaf counts the pages of all its forms. A form's bound is its
    pages and those of all others of about its length in the leaves where it would stand
    as a template. It stands on two pages, or is the most printed form of one of its leaves.
    """
    short = _short(forms)
    long_at, short_at = np.nonzero(~short)[0], np.nonzero(short)[0]
    long, size = forms.take(pa.array(long_at)), np.asarray(pc.utf8_length(forms))
    kept = {"<": [], ">": []}
    for i, f in zip(short_at.tolist(), forms.take(pa.array(short_at)).to_pylist()):
        for path in paths(f):
            kept[path[0]].append((i, path[1:]))
    bound, most, span = pages.astype(np.int64), np.zeros(len(forms), bool), int(size.max()) + 3
    weight = pages.astype(np.int64) * len(forms) + np.arange(len(forms))

    def leaves(at: np.ndarray, tokens: pa.Array, stands: np.ndarray) -> None:
        code = np.asarray(tokens.dictionary_encode().indices)
        top = np.full(code.max() + 1, -1)
        np.maximum.at(top, code, weight[at])
        a, c = at[stands], code[stands]
        most[a[top[c] == weight[a]]] = True
        # pages by leaf and length of the form: what is longer or shorter by more than two letters is another line
        cell, where = np.unique(code * span + size[at], return_inverse=True)
        total = np.append(np.bincount(where, pages[at]).astype(np.int64), 0)
        for d in range(-2, 3):
            want = c * span + size[a] + d
            k = np.searchsorted(cell, want)
            k[(k == len(cell)) | (cell[np.minimum(k, len(cell) - 1)] != want)] = len(cell)
            np.add.at(bound, a, total[k])
        np.add.at(bound, a, -pages[a])

    for place, cut_at in (("<", (0, TOKEN)), (">", (-TOKEN, None))):
        at = np.concatenate([long_at, np.array([i for i, _ in kept[place]], long_at.dtype)])
        tokens = pa.concat_arrays([_tokens(long, *cut_at), pa.array([t for _, t in kept[place]], pa.string())])
        if len(at):
            leaves(at, tokens, np.ones(len(at), bool))
    middle = np.nonzero(size >= LONG_FORM - 2)[0]
    if len(middle):
        of = forms.take(pa.array(middle))
        moved = [_tokens(of, k, k + TOKEN) for k in (TOKEN, TOKEN - 1, TOKEN + 1)]
        leaves(np.tile(middle, 3), pa.concat_arrays(moved), np.concatenate([size[middle] >= LONG_FORM, np.zeros(2 * len(middle), bool)]))
    found = np.nonzero((bound >= least) & ((pages >= 2) | most))[0]
    return found, bound[found]


def _local(lines: pa.Table, size: pa.Table) -> pa.Table:
    """Templates of one stretch; size has its pages and its part of the needed ones."""
    names = ["source", "base", "base_pages", "bound", "part"]
    if not lines.num_rows or not size.num_rows:
        return pa.table([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64())], names)
    part, whole = size.column("_part")[0].as_py(), size.column("_stretches")[0].as_py() == 1
    forms, pages = _page_counts(lines)
    found, bound = frequent(forms, pages, part if whole else part * REPORTED)
    source, n = lines.column("source")[0].as_py(), len(found)
    return pa.table([pa.array([source] * n, pa.string()), forms.take(pa.array(found)), pa.array(pages[found], pa.int64()), pa.array(bound, pa.int64()), pa.array([part] * n, pa.float64())], names)


def _matched(lines: pa.Table, known: pa.Table) -> pa.Table:
    """Lines of one stretch that are printings of a template."""
    printed = lines.select(["source", "page", "block_id", "line_no"])
    if not lines.num_rows or not known.num_rows:
        return printed.slice(0, 0).append_column("template", pa.array([], pa.string()))
    tree = TokenTree()
    for form, n in zip(known.column("base").to_pylist(), known.column("base_pages").to_pylist()):
        tree.add(form, n, template_paths(form))
    forms, pages = _page_counts(lines)
    # forms of full tokens that no path leads to a leaf are sorted out by columns
    met = _short(forms)
    for place, cuts in (("<", [(0, TOKEN)]), (">", [(-TOKEN, None)]), ("|", [(k, k + TOKEN) for k in (TOKEN - 1, TOKEN, TOKEN + 1)])):
        leaves = pa.array([x[1:] for x in tree.leaves if x[0] == place], pa.string())
        for a, b in cuts if len(leaves) else ():
            met = met | np.asarray(pc.is_in(_tokens(forms, a, b), leaves))
    at = np.nonzero(met)[0]
    found = {f: t for f, n in zip(forms.take(pa.array(at)).to_pylist(), pages[at].tolist()) if (t := tree.match(f, n))}
    coded = lines.column("form").combine_chunks().dictionary_encode()
    template = pa.array([found.get(f) for f in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    return printed.append_column("template", template).filter(template.is_valid())


def repeated_lines(
    blocks: DataFrame, source: str = "book_id", page: str = "page_index", key: str = "id", content: str = "content", least_pages: int = 6, share: float = 1 / 6, stretch: int = STRETCH
) -> DataFrame:
    """block_id, line_no, template of every printing of a line repeated excessively in its source.

    Excessive: on at least least_pages distinct pages and at least that share of the
    source's distinct pages. Null contents have no lines; rows without a source
    or page are not counted; repeated rows count once. Lines without letters and
    lines that are only a page number never count. An empty table gives an empty
    result; other columns are not looked at.
    """
    placed = blocks.where(F.col(source).isNotNull() & F.col(page).isNotNull())
    # one shuffle serves the trees of the stretches and, with the templates sent to each, the matching
    lines = cut_bucketed(lines_of(placed, source, page, key, content, stretch), "source", "stretch")
    per_page = placed.select(F.col(source).cast("string").alias("source"), F.col(page).cast("long").alias("page")).distinct().withColumn("stretch", F.floor(F.col("page") / stretch))
    per_stretch = per_page.groupBy("source", "stretch").agg(F.count("*").alias("_n"))
    whole = per_stretch.groupBy("source").agg(F.sum("_n").alias("_pages"), F.count("*").alias("_stretches"))
    needed = whole.withColumn("_need", F.greatest(F.lit(float(least_pages)), F.col("_pages") * F.lit(share)))
    sizes = per_stretch.join(needed, "source").select("source", "stretch", "_stretches", (F.col("_need") * F.col("_n") / F.col("_pages")).alias("_part"))
    by = ("source", "stretch")
    local = lines.groupBy(*by).cogroup(sizes.groupBy(*by)).applyInArrow(_local, "source string, base string, base_pages long, bound long, part double")
    merged = local.groupBy("source", "base").agg(F.sum("base_pages").alias("base_pages"), F.sum("bound").alias("_bound"), F.sum("part").alias("_told"))
    # a misread letter is the exception: the line itself must be printed twice
    bases = merged.join(needed, "source").where((F.col("base_pages") >= 2) & (F.col("_bound") + (F.col("_need") - F.col("_told")) * REPORTED >= F.col("_need") * (1 - 1e-9))).select("source", "base", "base_pages")
    sent = per_stretch.select(*by).join(bases, "source")
    met = lines.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(_matched, "source string, page long, block_id string, line_no int, template string")
    printed = cut(met)
    release(lines)
    covered = printed.select("source", "template", "page").distinct().groupBy("source", "template").agg(F.count("*").alias("_on"))
    heavy = covered.join(needed, "source").where((F.col("_on") >= least_pages) & (F.col("_on") >= F.col("_pages") * F.lit(share))).select("source", "template")
    return printed.join(heavy, ["source", "template"], "left_semi").select("block_id", "line_no", "template").distinct()


def without_lines(blocks: DataFrame, found: DataFrame, key: str = "id", content: str = "content") -> DataFrame:
    """blocks with clean_content: the content without the lines found; other contents stay as they are."""
    gone = found.groupBy(F.col("block_id").alias("_block")).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.array_join(F.filter(F.split(F.col(content), "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    return blocks.join(gone, F.col(key) == F.col("_block"), "left").withColumn(
        "clean_content", F.when(F.col("_gone").isNull(), F.col(content)).otherwise(F.regexp_replace(kept, r"\r?\n?$", ""))
    ).drop("_block", "_gone")
