import pytest
from pyspark.sql import functions as F

from quire.llm.markup import clean, line_blocks, markup_residue, number_signs

CASES = [
    ("<p>One.</p>", ["html"], "One."),
    ("R&amp;D and R&D", ["html"], "R&D and R&D"),
    ("<ul>\n  <li>One</li>\n  <li>Two</li>\n</ul>", ["html"], "- One\n- Two"),
    ("<h2 id='a'>Title</h2><p>Text</p>", ["html"], "## Title\nText"),
    ("\\section{Title}\nText\\footnotemark[3] $x_{1} \\leq y$", ["latex"], "## Title\nText $x_{1} \\leq y$"),
    ("\\begin{quote}Said.\\end{quote}", ["latex"], "> Said."),
    ("``Said.'' \\par", ["latex"], "“Said.”"),
    ("the {\\it old} town", ["latex"], "the old town"),
    ("== Title ==\nA ''word'' of [[Page|text]].\n[[Category:X]]", ["wiki"], "## Title\nA word of text."),
    ("{| class=\"x\"\n|-\n! A !! B\n|-\n| 1 || 2\n|}", ["wiki"], "A | B\n1 | 2"),
    ("## Title\n\nA **bold** [link](a.md) and `code`.", ["markdown"], "## Title\nA bold link and `code`."),
    ("Title\n=====\nText", ["markdown"], "# Title\nText"),
    ("```text\na = 1\n```", ["markdown"], "```text\na = 1\n```"),
    ("> quoted\n> text", ["markdown"], "> quoted\n> text"),
    ("Mark.[^fn-0058-6]", [], "Mark.[^fn-0058-6]"),
    ("(3 < 5; 7 > 2) C:\\plates\\ii #7 ~30 4|7 ^ {iv} $40–$55 2 * 3 * 4 = 24", [], None),
    ("plan_of_west_gate.tif [12] [sic] He paid 'twelve' and \"half\" `by weight.", [], None),
    ("1764. Nobody came\n- 12 -", [], None),
]


@pytest.mark.parametrize("text,kinds,cleaned", CASES)
def test_cases(spark, text, kinds, cleaned):
    r = markup_residue(spark.createDataFrame([(text, "old", "old")], "text string, clean_text string, markup_kinds string")).first()
    assert r.markup_kinds == kinds and r.clean_text == (text if cleaned is None else cleaned)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, False), (2, "", False), (2, "", False), (3, "<b>x</b>", True), (4, "<b>x</b>", None)], "k int, text string, skip boolean")
    got = sorted((r.k, r.markup_kinds or [], r.clean_text) for r in markup_residue(df, skip=F.col("skip")).collect() if r.k > 1)
    assert got == [(2, [], ""), (2, [], ""), (3, [], "<b>x</b>"), (4, ["html"], "x")]
    assert markup_residue(df.where("k = 1")).first().clean_text is None and markup_residue(df.limit(0)).count() == 0
    long = spark.createDataFrame([("word " * 100_000 + "<b>x</b>",)], "text string")
    assert markup_residue(long).first().clean_text.endswith("word x")


def test_line_blocks():
    assert line_blocks([0, 0, 50, 60, 0, 40, 0, 0, 0, 0, 3], 3, 40) == [False, False, True, True, True, True, False, False, False, False, False]
    assert clean("plain", []) == "plain"


def test_long_emphasis(spark):
    long = "the old harbour was closed " * 12 + "again"
    rows = spark.createDataFrame([(f"{s}{long}{s}",) for s in ("*", "_", "__")] + [(long,)], "text string")
    got = [(list(r.markup_kinds), r.clean_text) for r in markup_residue(rows).collect()]
    assert got == [(["markdown"], long)] * 3 + [([], long)]


MENU = ["<div>Home</div>", "<div>About</div>", "<ul><li><a href='/i'>Impressum</a></li></ul>"]
TEXT = ["<h2>The harbour</h2>", "<p>The old harbour was closed to every ship before the winter came.</p>", "<p>Nobody knew why.</p>"]
FOOT = ["", "", "", "", "<div>Privacy</div>", "<h3>Notes</h3>", "<pre>a = 1</pre>"]


def test_surge_and_dive_decide_lines():
    page = "\n".join(MENU + ["", "", "", ""] + TEXT + FOOT)
    assert clean(page, ["html"]) == "## The harbour\nThe old harbour was closed to every ship before the winter came.\n\nNobody knew why.\n### Notes\n```\na = 1\n```"
    assert clean("\n".join(MENU), ["html"]) == "Home\nAbout\n- Impressum"  # no text, no outside
    links = "[Home](/) [About](/a)\n\n\n\nThe old harbour was closed to every ship before the winter came.\n\n\n\n\nA caption\n\n\n\n[Next](/n)"
    assert clean(links, ["markdown"]) == "The old harbour was closed to every ship before the winter came.\nA caption"
    wiki = "[[A|Next page]]\n\n\n\nThe old [[harbour]] was closed to every ship before the winter came."
    assert clean(wiki, ["wiki"]) == "The old harbour was closed to every ship before the winter came."


BODY = "The old harbour was closed to every ship before the winter came."
NUMBERS = [
    (f"{BODY}\n== 12 ==", []),  # below the text: a page number
    (f"== 12 ==\n{BODY}", ["wiki"]),  # above the text: a heading
    (f"{BODY}\n*xii*\n{BODY}", ["markdown"]),  # within the text
    (f"{BODY}\n\n*12*", []),
    ("*12*", ["markdown"]),  # no text to stand below
    (f"<p>{BODY}</p>\n== 12 ==", ["html"]),
    (f"{BODY}\n- 12 -\n- 13 -", []),  # no list
    ("- One\n- 12 -\n- Two", ["markdown"]),
    ("```\nold\n```\n- 12 -\n- 13 -", ["markdown"]),
    (f"{BODY}\n*mild*", ["markdown"]),
    (f"{BODY}\n- 12\n- 13", ["markdown"]),
]


def test_page_numbers_outside_text_are_no_residue(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NUMBERS)], "k int, text string")
    for with_text in (False, True):
        got = {r.k: r.markup_kinds for r in markup_residue(rows, with_text=with_text).collect()}
        assert [got[i] for i in range(len(NUMBERS))] == [k for _, k in NUMBERS]
    text = {r.k: r.clean_text for r in markup_residue(rows).collect()}
    assert [text[0], text[1], text[5]] == [NUMBERS[0][0], f"## 12\n{BODY}", f"{BODY}\n== 12 =="]
    assert [number_signs(x) for x in ("- 12 -", "— Seite 4 —", "== xii ==", "---", "- 12", "*civil*", "", "-" * 100_000)] == ["-", "—", "==", "", "", "", "", ""]


def test_distribution_decides_found(spark):
    # the same lines, the number far below the text or with text after it
    rows = spark.createDataFrame([(f"{BODY}\n\n\n\n__12__\n{after}",) for after in ("", BODY)], "text string")
    assert [r.markup_kinds for r in markup_residue(rows, with_text=False).collect()] == [[], ["markdown"]]


def test_double_underscores(spark):
    cases = [("after the long __winter__. The witnesses", "after the long winter. The witnesses"), ("厄尔巴__尔苏特__的天文学家", "厄尔巴尔苏特的天文学家"), ("see __init__.py, a__b__c", None)]
    got = [(r.markup_kinds, r.clean_text) for r in markup_residue(spark.createDataFrame([(t,) for t, _ in cases], "text string")).collect()]
    assert got == [(["markdown"], c) if c else ([], t) for t, c in cases]
