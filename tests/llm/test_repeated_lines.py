from quire.llm.repeated_lines import TokenTree, is_page_number, line_form, paths, repeated_lines, same_line, template_paths, within, without_lines

SCHEMA = "id string, book_id string, page_index int, content string, source string, form string, template string"


def book(spark, pages):
    return spark.createDataFrame([(f"b{i}", b, p, t, "x", "x", "x") for i, (b, p, t) in enumerate(pages)], SCHEMA)


def test_finds_variants_and_nothing_else(spark):
    head = ["The Chronicle of Lodlenvel, new edition", "THE CHRONICLE OF LODLENVEL, NEW EDITION  ·  7", "[12] The  Chronicle of Lodlenvel new edition", "The Chronicle of Lodlenve1, new edition", "The Chronicl of Lodlenvel, new edition", "x\r\nThe Chronicle of Lodlenvel, new edition\r"]
    pages = [("a", i, f"body number {'abcdefghij'[i]} stands here alone\n{head[i % 6]}") for i in range(10)]
    pages += [("a", 3, pages[3][2]), ("b", 0, head[0]), (None, 1, head[0]), ("a", None, head[0]), ("a", 1, None), ("a", 2, "")]
    rows = book(spark, pages)
    found = {(r.block_id, r.line_no) for r in repeated_lines(rows).collect()}
    assert found == {(f"b{i}", 2 if i % 6 == 5 else 1) for i in range(10)} | {("b10", 1)}
    clean = {r.id: r.clean_content for r in without_lines(rows, repeated_lines(rows)).collect()}
    assert clean["b0"] == "body number a stands here alone" and clean["b11"] == head[0] and clean["b14"] is None


def test_thresholds_are_on_distinct_pages(spark):
    six = [("a", p, "Scanned at the old hall") for p in range(6)] + [("a", p, f"filler {chr(97 + p % 26)}{chr(97 + p // 26)} qqq") for p in range(6, 37)]
    assert repeated_lines(book(spark, six)).count() == 0  # 6 of 37 pages are less than a sixth
    assert repeated_lines(book(spark, six[:-1])).count() == 6
    assert repeated_lines(book(spark, [("a", 1, "Scanned at the old hall")] * 9)).count() == 0


def test_a_source_of_many_stretches(spark):
    pages = [("a", p, "Share this leaf with a friend" if p % 5 == 0 else " ".join("abcdefghij"[int(c)] * 4 for c in str(p))) for p in range(900)]
    assert repeated_lines(book(spark, pages)).count() == 180
    assert repeated_lines(book(spark, []), stretch=8).count() == 0


def test_page_numbers_never_count():
    for x in ("p. 12", "– 13 –", "xiv", "[7]", "Page 3", "9*", "12 / 300", "S. 4"):
        assert is_page_number(x) and line_form(x) is None
    assert line_form("12 The end") == "theend" and line_form("--- 77 ...") is None and line_form("Ümlaut") == "umlaut"


def test_very_long_line(spark):
    assert repeated_lines(book(spark, [("a", p, "x y " * 200_000) for p in range(6)])).count() == 6


def test_a_damaged_letter_in_a_short_line(spark):
    heads = [("Old Harbour", "Old Horbour"), ("Old Harbour", "Old Habour"), ("Vorwort", "Vorwart"), ("Vorwort", "Vowort"), ("Schornstein", "Schomstein")]
    pages = [(f"k{k}", i, f"{b if i == 3 else a}\nbody {'abcdefgh'[i] * 5} stands here") for k, (a, b) in enumerate(heads) for i in range(8)]
    assert {(r.block_id, r.line_no) for r in repeated_lines(book(spark, pages)).where("line_no = 0").collect()} == {(f"b{i}", 0) for i in range(40)}
    apart = [("a", i, f"{'Schmuck' if i == 3 else 'Vorwort'}") for i in range(8)]
    assert repeated_lines(book(spark, apart)).count() == 7


def test_pages_far_apart(spark):
    for step in (1, 300):
        pages = [("a", p * step, f"The Chronicle of Lodlenvel\n{'abcdefgh'[p] * 9} stands here") for p in range(8)]
        assert repeated_lines(book(spark, pages)).count() == 8


def test_no_printing_within_reach_misses_its_leaf():
    for form in ("vorwort", "oldharbour", "schornstein", "chronicleoftheoldharbour", "thechronicleoftheoldharbouranditskeepers"):
        reach = 2 if len(form) >= 24 else 1
        damaged = {form}
        for _ in range(reach):
            damaged |= {f[:i] + x + f[i + k :] for f in damaged for i in range(len(f)) for k in (0, 1) for x in ("", "q") if f[:i] + x + f[i + k :]}
        tree = TokenTree()
        tree.add(form, 9, template_paths(form))
        assert all(tree.match(f) == form for f in damaged if len(f) >= len(form) - reach and len(f) > 1)
    assert same_line("schomstein", "schornstein") and not same_line("schmuck", "vorwort") and within("abc", "abd", 1) and not within("abc", "xyz", 2)
    assert len(paths("x" * 60)) == 5


def test_marks_behind_a_number_and_hardly_printed_forms(spark):
    assert line_form("The old harbour | page 123 " + "*" * 90) == "theoldharbour" and line_form(" " * 90 + "12") is None
    mostly = [("a", p, "The keepers of the old harbour" if p < 2 else "The keepers of the old harbour"[:p] + "q" + "The keepers of the old harbour"[p + 1 :]) for p in (0, 1, 4, 5, 6, 8, 9, 10)]
    assert repeated_lines(book(spark, mostly)).count() == 8


def test_a_third_of_all_rows_in_one_source(spark):
    pages = [("big", p, ("Share this leaf" if p % 6 == 0 else "only here") + f"\n{'abcdefghijklmnopqrstuvwxyz'[p % 26] * 5}{'abcdefghijklmnopqrstuvwxyz'[p // 26 % 26] * 5}{'abc'[p // 676] * 5}") for p in range(1500)]
    found = repeated_lines(book(spark, pages), stretch=64)
    assert {(r.template, r["count"]) for r in found.groupBy("template").count().collect()} == {("sharethisleaf", 250), ("onlyhere", 1250)}
