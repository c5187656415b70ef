"""Text functions as Columns: headings, numbering, terms, tokens, footnotes, hashes.

Patterns use the Unicode classes of Java and treat null as null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Number words and labels of headings.
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten"]
LABELS = "part|teil|book|volume|chapter|kapitel"
TITLE_LABELS = ["part", "chapter", "book", "volume", "teil", "kapitel"]
TITLE_STOPWORDS = ["a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "with"]
_LABELLED = rf"(?i)^({LABELS})\s+([ivxlcdm]+|\d+|{'|'.join(NUMBER_WORDS)})(?![\p{{L}}\p{{N}}_])[:.]?\s*(.*)$"
_ROMAN = r"^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"
_ZONES = {
    "notes": "notes|endnotes|anmerkungen|注释|注",
    "bibliography": "references|bibliography|works cited|literatur|literaturverzeichnis|参考文献",
    "index": "index|name index|subject index|personenregister|sachregister|namenregister|索引",
}


def squeeze(c: Column) -> Column:
    """Runs of white space (no-break blanks too) to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\x{00A0}]+", " "))


def clean_content(c: Column) -> Column:
    """Content without stacked leading hashes, white space collapsed."""
    return squeeze(F.regexp_replace(c, r"^(?:\s*#{1,6}\s*)+", ""))


def source_level(c: Column) -> Column:
    """Number of leading hashes; null for none."""
    return F.nullif(F.length(F.regexp_extract(F.ltrim(c), r"^(#+)", 1)), F.lit(0))


def unescape(c: Column) -> Column:
    """The five XML entities, the no-break blank and the decimal reference to the apostrophe; others stay as they are."""
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def canonical_heading(c: Column) -> Column:
    """A heading without hashes, tags, entities and underline wrappers."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"^(?:\s*#{1,6}\s*)+", ""), r"<[^>]+>", " ")
    return squeeze(F.regexp_replace(unescape(s), r"^\$?\s*\\?underline\s*\{([^{}]+)\}\s*\$?", "$1"))


def numbering(c: Column) -> Column:
    """struct(token, path, depth, family) of a heading's numbering; null without one.

    Precedence: section symbol, label with number, decimal path, single letter,
    plain number.
    """
    h = canonical_heading(c)
    part = lambda p, i: F.regexp_extract(h, p, i)
    section, decimal = r"(?i)^§\s*([0-9Il|]+)$", r"^(\d+(?:\.\d+){1,5})(?:[.)])?\s+(.+)$"
    letter, simple = r"^([A-Za-z])(?:[.)])\s+(.+)$", r"(?i)^(\d+|[IVXLCDM]+)(?:[.)])?\s+(.+)$"
    sign = F.translate(part(section, 1), "Iil|", "1111")

    def made(token: Column, path: Column, depth: Column, family: Column) -> Column:
        return F.struct(token.alias("token"), path.alias("path"), depth.cast("int").alias("depth"), family.alias("family"))

    return (
        F.when(h.rlike(section), made(F.concat(F.lit("§"), sign), F.array(F.lit("§"), sign), F.lit(2), F.lit("section_symbol")))
        .when(h.rlike(_LABELLED), made(part(_LABELLED, 2), F.array(F.lower(part(_LABELLED, 1)), F.lower(part(_LABELLED, 2))), F.lit(1), F.lower(part(_LABELLED, 1))))
        .when(h.rlike(decimal), made(part(decimal, 1), F.split(part(decimal, 1), r"\."), F.size(F.split(part(decimal, 1), r"\.")), F.lit("decimal")))
        .when(h.rlike(letter), made(part(letter, 1), F.array(part(letter, 1)), F.lit(1), F.when(part(letter, 1).rlike("[A-Z]"), "upper_letter").otherwise("lower_letter")))
        .when(h.rlike(simple), made(part(simple, 1), F.array(F.lower(part(simple, 1))), F.lit(1), F.lit("simple")))
    )


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.when(squeeze(c) == "", 0).otherwise(F.size(F.split(squeeze(c), " ")))


def rejection_reason(c: Column) -> Column:
    """Why a line is no heading; null if it may be one."""
    h = canonical_heading(c)
    return (
        F.when(h == "", "empty")
        .when(h.rlike(r"^[\s*~◇◆△▲▽▼○●□■·•—–_\-=]+$"), "decorative_only")
        .when(h.rlike(r"(?i)^(?:p(?:age)?\.?\s*)?[ivxlcdm\d]+$"), "folio_or_numeric_only")
        .when(F.length(h) > 180, "too_long")
        .when(word_count(h) > 24, "sentence_like")
        .when(h.rlike(_LABELLED), None)
        .when(h.rlike("[?!。？！]$") & (word_count(h) > 7), "quotation_or_sentence")
    )


def is_label_only(c: Column) -> Column:
    """Whether a heading is only a label with its number."""
    h = canonical_heading(c)
    return h.rlike(_LABELLED) & (F.trim(F.regexp_extract(h, _LABELLED, 3)) == "")


def is_title_like(c: Column) -> Column:
    """Whether a short block of at most four lines can continue a title."""
    h = canonical_heading(c)
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return (h != "") & (F.length(h) <= 120) & (word_count(h) <= 20) & F.size(lines).between(1, 4) & F.forall(lines, lambda x: F.length(x) <= 90)


def normalized_title(c: Column) -> Column:
    """A title without its number, hashes and part label, in lower case, words only."""
    s = F.regexp_replace(c, r"^\s*(?:\d+(?:\.\d+)*|[IVXLCDM]+)[.)]?\s+", "")
    s = F.regexp_replace(F.trim(s), r"^(?:\s*#{1,6}\s*)+", "")
    s = F.regexp_replace(s, r"(?i)^(?:part|book|volume|teil)\s+(?:\d+|[ivxlcdm]+)\s*[:.·–—-]*\s*", "")
    s = F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}_]+", " "))
    return F.regexp_replace(s, r"^list of\s+", "")


def roman_value(c: Column) -> Column:
    """Value of a roman numeral by the subtractive rule; null if it is none."""
    letters = F.reverse(F.filter(F.split(F.upper(c), ""), lambda x: x != ""))
    value = F.create_map(*[F.lit(x) for p in (("I", 1), ("V", 5), ("X", 10), ("L", 50), ("C", 100), ("D", 500), ("M", 1000)) for x in p])
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    folded = F.aggregate(
        letters,
        start,
        lambda s, x: F.struct(
            F.when(value[x] < s["last"], s["total"] - value[x]).otherwise(s["total"] + value[x]).alias("total"),
            F.greatest(s["last"], value[x]).alias("last"),
        ),
        lambda s: s["total"],
    )
    return F.when(F.upper(c).rlike(_ROMAN) & (c != ""), folded)


def number_value(c: Column) -> Column:
    """Arabic, roman, Chinese (to the hundreds) or spelled-out number as int; null otherwise."""
    s = F.lower(F.trim(c))
    words = F.create_map(*[x for i, w in enumerate(NUMBER_WORDS, 1) for x in (F.lit(w), F.lit(i))])
    digit = lambda x: F.nullif(F.instr(F.lit("一二三四五六七八九"), x), F.lit(0))
    hundreds = F.when(s.contains("百"), F.coalesce(digit(F.substring_index(s, "百", 1)), F.lit(1)) * 100).otherwise(0)
    rest = F.regexp_replace(F.when(s.contains("百"), F.substring_index(s, "百", -1)).otherwise(s), "^零", "")
    tens = F.when(rest.contains("十"), F.when(rest.startswith("十"), 10).otherwise(digit(F.left(rest, F.lit(1))) * 10)).otherwise(0)
    ones = F.coalesce(digit(F.right(rest, F.lit(1))), F.lit(0))
    return (
        F.when(s.rlike(r"^\d{1,9}$"), s.try_cast("int"))
        .when(s.rlike("^[零一二三四五六七八九十百]+$"), hundreds + tens + ones)
        .when(F.array_contains(F.array(*map(F.lit, NUMBER_WORDS)), s), words[s])
        .otherwise(roman_value(s))
    )


def heading_identity(c: Column) -> Column:
    """struct(kind, ordinal) of a part or chapter heading in English, German or Chinese, or of a leading number."""
    h = canonical_heading(c)
    latin, han, plain = rf"(?i)^({LABELS})\s+(\w+)", "^第([零一二三四五六七八九十百\\d]+)(部|编|卷|章)", r"^(\d+)[.)]?\s"
    word = F.lower(F.regexp_extract(h, latin, 1))
    kind = F.when(word.isin("chapter", "kapitel"), "chapter").otherwise("part")
    return (
        F.when(h.rlike(latin), F.struct(kind.alias("kind"), number_value(F.regexp_extract(h, latin, 2)).alias("ordinal")))
        .when(h.rlike(han), F.struct(F.when(F.regexp_extract(h, han, 2) == "章", "chapter").otherwise("part").alias("kind"), number_value(F.regexp_extract(h, han, 1)).alias("ordinal")))
        .when(h.rlike(plain), F.struct(F.lit("chapter").alias("kind"), number_value(F.regexp_extract(h, plain, 1)).alias("ordinal")))
    )


def zone_of_heading(c: Column) -> Column:
    """notes, bibliography or index if a heading opens that zone; else null."""
    h = F.lower(canonical_heading(c))
    out = F.lit(None).cast("string")
    for zone, words in reversed(_ZONES.items()):
        out = F.when(h.isin(*words.split("|")), zone).otherwise(out)
    return out


def term_normal(c: Column) -> Column:
    """Lower case, dashes alike, words only."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "–—", "--"), r"[^\p{L}\p{N}_]+", " "))


def join_normal(c: Column) -> Column:
    """term_normal without words of one or two letters."""
    return F.array_join(F.filter(F.split(term_normal(c), " "), lambda x: F.length(x) > 2), " ")


def phrase_pattern(c: Column) -> Column:
    """Regular expression for a phrase whose words may be parted by blanks, dashes or commas."""
    words = F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+(?:[’'][\p{L}\p{N}_]+)?"), 0)
    return F.concat(F.lit(r"(?i)(?<![\p{L}\p{N}_])"), F.array_join(words, r"[\s\-–—,]+"), F.lit(r"(?![\p{L}\p{N}_])"))


def block_text(content: Column, label: Column) -> Column:
    """Text of a block: tables keep their lines, everything else collapses."""
    lines = F.filter(F.transform(F.split(content, "\n"), squeeze), lambda x: x != "")
    return F.when(label == "table", F.array_join(lines, "\n")).otherwise(squeeze(content))


_FOOTNOTE = r"(?s)^\s*(?:\$\s*\^\{?(\d+)\}?\s*\$|\[(\d+)\]|(\d+)[.)])\s*(.*)$"


def footnote_number(c: Column) -> Column:
    """Number before a footnote's body; null without one."""
    return F.nullif(F.concat(*[F.coalesce(F.regexp_extract(c, _FOOTNOTE, i), F.lit("")) for i in (1, 2, 3)]), F.lit(""))


def footnote_body(c: Column) -> Column:
    """A footnote without its number."""
    return F.when(footnote_number(c).isNotNull(), F.trim(F.regexp_extract(c, _FOOTNOTE, 4))).otherwise(F.trim(c))


def replace_marker(text: Column, number: Column, reference: Column) -> Column:
    """The first marker of a footnote number (formula, caret or circled digit) replaced by a reference."""
    n = number.cast("int")
    circled = F.element_at(F.array(*[F.lit(chr(0x2460 + i)) for i in range(20)]), F.when(n.between(1, 20), n).otherwise(1))
    raised = F.translate(n.cast("string"), "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")
    marks = F.filter(
        F.array(
            F.concat(F.lit("$^{"), n.cast("string"), F.lit("}$")),
            F.concat(F.lit("$ ^{"), n.cast("string"), F.lit("} $")),
            F.concat(F.lit("$^"), n.cast("string"), F.lit("$")),
            F.concat(F.lit("^{"), n.cast("string"), F.lit("}")),
            F.when(n.between(1, 20), circled),
            raised,
        ),
        lambda m: m.isNotNull() & text.contains(m),
    )
    first = F.try_element_at(F.array_sort(F.transform(marks, lambda m: F.struct(F.instr(text, m).alias("at"), (-F.length(m)).alias("len"), m.alias("mark")))), F.lit(1))
    return F.when(first.isNull(), text).otherwise(
        F.concat(F.left(text, first["at"] - 1), reference, F.substr(text, first["at"] - first["len"]))
    )


def normalize_url(c: Column) -> Column:
    """A URL without sentence punctuation at its end, cut at the first East Asian character."""
    s = F.regexp_replace(c, "[.,;:!?。；！？、，]+$", "")
    return F.regexp_replace(s, r"[　-鿿가-퟿豈-﫿＀-￯].*$", "")


def urls(c: Column) -> Column:
    """Normalized URLs of a text."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"https?://\S+"), 0), normalize_url)


def roman_tokens(c: Column) -> Column:
    """Upper-case roman numerals that stand between other than Latin letters."""
    return F.filter(F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z])[IVXLCDM]+(?![A-Za-z])"), 0), lambda x: x.rlike(_ROMAN))


def strip_protected(c: Column) -> Column:
    """Text without protected inline tokens of the form ⟦name⟧, each a blank."""
    return squeeze(F.regexp_replace(c, r"⟦[^⟧]*⟧", " "))


def clean_lines(c: Column) -> Column:
    """Lines with white space collapsed, empty ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), squeeze), lambda x: x != ""), "\n")


def residual_run(c: Column) -> Column:
    """Length of the longest run of words in Latin letters only."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    return F.aggregate(
        F.split(squeeze(c), " "),
        start,
        lambda s, x: F.struct(
            F.when(x.rlike(r"^[A-Za-z]+(?:['’\-][A-Za-z]+)*$"), s["now"] + 1).otherwise(0).alias("now"),
            F.greatest(s["best"], F.when(x.rlike(r"^[A-Za-z]+(?:['’\-][A-Za-z]+)*$"), s["now"] + 1).otherwise(0)).alias("best"),
        ),
        lambda s: s["best"],
    )


#: Words that begin sentences rather than names.
SENTENCE_STARTERS = (
    "The In On At By For As A An To From But And This That These Those It He She They We You When While Since After Before With However Moreover Yet "
    "During Within Without Between Among Against Through Because Although If Then There Here What Why How Only Also Even Still Just Indeed Clearly Perhaps "
    "One Two Both Each Most Many Much Little Few No Not More New Out Up Down Over Under Next Last Today Recently Earlier Later Finally Meanwhile Soon Now"
).split()


def capitalized_runs(c: Column) -> Column:
    """Runs of two and more capitalized words that begin no sentence, as strings."""
    words = F.transform(F.split(squeeze(c), " "), lambda x: F.regexp_replace(x, r"[^A-Za-zÀ-ÖØ-öø-ÿ’'\-]+$", ""))
    named = lambda x: x.rlike(r"^[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ’'\-]+$") & ~x.isin(SENTENCE_STARTERS)
    joined = F.array_join(F.transform(words, lambda x: F.when(named(x), x).otherwise("\u0001")), " ")
    return F.filter(F.transform(F.split(joined, "\u0001"), lambda x: F.trim(x)), lambda x: x.contains(" "))


def span_survives(span: Column, target: Column) -> Column:
    """Whether a span or any two neighbouring words of it stand in the target."""
    words = F.split(span, " ")
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, F.lit(2)), " "))
    return target.contains(span) | F.exists(pairs, lambda p: target.contains(p))


def digest(*parts: Column) -> Column:
    """sha256 over parts joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """Prefix and the first 16 hex digits of sha1 over the parts; null prints as None."""
    return F.concat(F.lit(prefix), F.left(F.sha1(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), F.lit(16)))


def text_units(c: Column) -> Column:
    """Latin words and single other characters."""
    return F.regexp_extract_all(c, F.lit(r"[\x21-\xFF]+|[^\s\x21-\xFF]"), 0)


def publishable(c: Column) -> Column:
    """Markdown for printing: comments and very long digit runs dropped, a blank line before headings."""
    s = F.regexp_replace(c, r"(?s)<!--.*?-->\n?", "")
    s = F.regexp_replace(F.regexp_replace(s, r">([^<>\n]+)<", "*$1*"), r"\d{100,}", "")
    return F.regexp_replace(s, r"([^\n])\n(#{1,6} )", "$1\n\n$2")
