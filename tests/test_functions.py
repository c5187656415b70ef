import pytest
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions import text as tx
from quire.functions.similarity import sequence_ratio, title_similarity, token_set_ratio


def one(spark, fn, *values):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'int' if isinstance(v, int) else 'string'}" for n, v in zip(names, values)))
    return df.select(fn(*map(F.col, names)).alias("v")).first().v


@pytest.mark.parametrize(
    "fn,value,want",
    [
        (tx.clean_content, "## ### Title  here ", "Title here"), (tx.source_level, "### x", 3), (tx.source_level, "x", None), (tx.canonical_heading, "# A <b>B</b> &amp; C", "A B & C"),
        (tx.canonical_heading, "$\\underline{Part}$ One", "Part One"), (tx.rejection_reason, "***", "decorative_only"), (tx.rejection_reason, "page 12", "folio_or_numeric_only"), (tx.rejection_reason, "", "empty"),
        (tx.rejection_reason, "Is this really a sentence that asks something?", "quotation_or_sentence"), (tx.rejection_reason, "Chapter I: How did they all become rich so very quickly?", None), (tx.rejection_reason, "w " * 30, "sentence_like"),
        (tx.is_label_only, "Chapter IV", True), (tx.is_label_only, "Chapter IV: On", False), (tx.is_title_like, "Introduction:\nHow", True), (tx.normalized_title, "2.1 The Ñame of—things", "the ñame of things"), (tx.normalized_title, "Part IV: On", "on"),
        (tx.roman_value, "MCMXCIV", 1994), (tx.roman_value, "IIII", None), (tx.number_value, "二百三十一", 231), (tx.number_value, "十二", 12), (tx.number_value, "seven", 7), (tx.number_value, "xiv", 14), (tx.number_value, "x9", None),
        (tx.zone_of_heading, "# Bibliography", "bibliography"), (tx.zone_of_heading, "Bibliography of cats", None), (tx.term_normal, "Post–War  Era!", "post war era"), (tx.join_normal, "The War of 1812", "the war 1812"),
        (tx.footnote_number, "$^{12}$ Note", "12"), (tx.footnote_number, "[3] Note", "3"), (tx.footnote_number, "Note", None), (tx.footnote_body, "4. Note", "Note"), (tx.normalize_url, "https://a.b/c。文", "https://a.b/c"),
        (tx.strip_protected, "a ⟦b⟧ c", "a c"), (tx.clean_lines, " a \n\n b  c ", "a\nb c"), (tx.residual_run, "他 the old man went 他 home", 4), (tx.publishable, "a\n# B\n<!-- x -->\nc", "a\n\n# B\nc"), (tx.word_count, " ", 0),
    ],
)
def test_text(spark, fn, value, want):
    assert one(spark, fn, value) == want
    assert one(spark, lambda c: fn(F.when(c == "never", c)), value) in (None, False)


@pytest.mark.parametrize(
    "title,want",
    [("§ 1l", ("§11", "section_symbol", 2)), ("Chapter IV: On", ("IV", "chapter", 1)), ("2.1.3 On", ("2.1.3", "decimal", 3)), ("A. On", ("A", "upper_letter", 1)), ("b) on", ("b", "lower_letter", 1)), ("12 On", ("12", "simple", 1)), ("On", None)],
)
def test_numbering(spark, title, want):
    n = one(spark, tx.numbering, title)
    assert (n and (n.token, n.family, n.depth)) == want


def test_lists_and_pairs(spark):
    assert one(spark, tx.roman_tokens, "In XIV and IIII, 第II军") == ["XIV", "II"] and one(spark, tx.urls, "see https://a.b/c. and http://x") == ["https://a.b/c", "http://x"]
    assert one(spark, tx.capitalized_runs, "The Old Bridge of New York and Great Stone Gate.") == ["Old Bridge", "Great Stone Gate"]
    assert one(spark, tx.span_survives, "Great Stone Gate", "a Stone Gate b") and not one(spark, tx.span_survives, "Great Stone", "great stone")
    assert one(spark, lambda c: tx.heading_identity(c), "第十二章 起源").ordinal == 12 and one(spark, lambda c: tx.heading_identity(c), "Teil II").kind == "part"
    assert one(spark, tx.replace_marker, "a $^{3}$ b ③", 3, "[^x]") == "a [^x] b ③" and one(spark, tx.replace_marker, "none", 3, "[^x]") == "none"
    assert one(spark, lambda c: tx.block_text(c, F.lit("table")), "a  b\n\nc") == "a b\nc" and one(spark, lambda c: tx.block_text(c, F.lit("text")), "a\nb") == "a b"
    assert one(spark, tx.text_units, "ab 漢字 c") == ["ab", "漢", "字", "c"]
    pattern = one(spark, tx.phrase_pattern, "old town")
    assert spark.createDataFrame([("the Old–Town.",), ("oldtown",)], "s string").where(F.regexp_like("s", F.lit(pattern))).count() == 1
    assert one(spark, lambda c: tx.stable_id("blk-", c, F.lit(None)), "a").startswith("blk-") and len(one(spark, tx.digest, "a")) == 64


def test_similarity(spark):
    a, b = "Erster Teil: Die Lehre", "Zweiter Teil: Die Lehre"
    assert one(spark, title_similarity, a, a) == 1.0 and 0.5 < one(spark, title_similarity, a, b) < 1 and one(spark, title_similarity, "", a) == 0.0
    assert one(spark, token_set_ratio, "old town gate", "gate of old town") > 0.9 and abs(one(spark, sequence_ratio, "abcd", "bcde") - 0.75) < 1e-9


def test_boxes(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    r = spark.range(1).select(
        geo.intersection_ratio(box(0, 0, 10, 10), box(5, 0, 20, 10)).alias("i"), geo.horizontal_overlap(box(0, 0, 10, 1), box(5, 5, 15, 6)).alias("h"), geo.vertical_gap(box(0, 0, 1, 2), box(0, 5, 1, 6)).alias("v"),
        geo.normalized(box(1, 2, 3, 4), F.lit(0.0), F.lit(4.0)).alias("n"), geo.area(F.lit(None).cast("array<double>")).alias("z"),
    ).first()
    assert (r.i, r.h, r.v, r.n, r.z) == (0.5, 0.5, 3.0, [1.0, 0.5, 3.0, 1.0], 0.0)
