from collections import Counter

from quire.llm.scan_noise import CONFUSIONS, Furniture, Reader, Trie, aligned, fold, judge, learned_confusions, page_spans, roman, scan_noise, vocabulary, without_furniture

BODY = "The northern garrison supported the manuscript of the second volume. The register lists 439 entries, and the window was closed. "
B = "id string, book_id string, page_index int, label string, content string, origin string, noise string"
S = "id string, book_id string, page_json int, kind string, source_text string, page int"


def frames(spark, extra_blocks=(), segments=()):
    words = BODY.split()
    blocks = [(f"b{i}", "bk", i % 12, "text", " ".join(words[i % 20 :] + words[: i % 20]) + f" {'abcdefghij'[i % 10]}{'klmnop'[i // 10]}.", "x", "x") for i in range(60)]
    blocks += [(f"h{i}", "bk", i, "header", "The Chronicle of Lodlenvel, new edition", "x", "x") for i in range(12)]
    blocks += [(f"n{i}", "bk", i, "number", str(i + 1), "x", "x") for i in range(12)]
    return spark.createDataFrame(blocks + list(extra_blocks), B), spark.createDataFrame(list(segments), S)


def test_finds_and_repairs(spark):
    extra = [
        ("x1", "bk", 3, "text", "The northerri garrison supported the manu-\nscript.", "", ""),
        ("x2", "bk", 4, "text", "The register\nTHE CHRONICLE OF LODLENVEL, NEW EDITION\nlists 12 entries.\n– 5 –", "", ""),
        ("x3", "bk", 5, "text", "The window was clo5ed and the garri¬", "", ""),
        ("x4", "bk", 5, "text", None, "", ""),
        ("x5", "bk", 5, "text", "", "", ""),
        ("x1", "bk", 3, "text", "The northerri garrison supported the manu-\nscript.", "", ""),
        (None, "bk", 3, "text", "lost", "", ""),
    ]
    seg = [
        ("s1", "bk", 4, "paragraph", "The register The Chronicle of Lodlenve1, new edition lists 439 entries, and the window p. 5 was closed.", 1),
        ("s2", "bk", 4, "paragraph", "Both the pre- and post-war garrison.", 1),
        ("s3", "other", 4, "paragraph", "The northerri garrison.", 1),
        ("s4", "bk", None, "paragraph", "The garrison.", 1),
    ]
    blocks, segments = frames(spark, extra, seg)
    rows = {(r.origin, r.record_key): r for r in scan_noise(blocks, segments, with_text=True).collect()}
    noise = {k[1]: sorted(r.noise) for k, r in rows.items()}
    assert noise["x1"] == ["hyphen_break", "misread"] and noise["x2"] == ["page_number", "running_line"] and noise["x3"] == ["hyphen_break", "misread"]
    assert noise["x4"] == noise["x5"] == noise["b0"] == noise["s2"] == noise["s4"] == []
    assert noise["s1"] == ["page_number", "running_line"] and ("segments", "s3") not in rows and len(rows) == 60 + 5 + 3
    assert rows[("blocks", "x1")].clean_text == "The northern garrison supported the manuscript."
    assert rows[("blocks", "x2")].clean_text == "The register lists 12 entries." and rows[("blocks", "x4")].clean_text is None


def test_empty_tables_and_long_text(spark):
    blocks, segments = frames(spark)
    assert scan_noise(blocks.limit(0), segments.limit(0)).count() == 0
    assert scan_noise(blocks, None).count() == 60
    long, _ = frames(spark, [("x", "bk", 0, "text", " ".join(BODY.split()[::-1]) * 5000 + " windovv", "", "")])
    assert [r.noise for r in scan_noise(long, segments).where("record_key = 'x'").collect()] == [["misread"]]


def test_automaton_finds_all_within_reach():
    words = {"window": 9, "winter": 5, "garden": 7, "market": 3, "mark": 2}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    t = Trie(words)
    for q in ("windw", "winder", "gardn", "marke", "marks", "zzz"):
        assert set(t.near(q, confusions=0, edits=2)) == {w for w in words if distance(q, w) <= 2}
    assert Reader(words).right("winclow") == "window" and Reader(words).right("garderi") == "garden" and Reader(words).right("house") is None
    assert Reader(words).ranked("mark3t", set())[0] == "market"


def test_pieces():
    assert roman(14) == "xiv" and aligned("abcdef", "abxdefgh", 1) == 6 and aligned("abc", "xyz", 2) == -1
    assert page_spans("The third table [12] shows 12 entries", 11, 1, [], False) == [(16, 20)]
    assert Furniture([]).spans("anything") == []


def test_running_lines_of_the_whole_book(spark):
    """Rows without a page know every running line of their book, and a stretch all of those beside it."""
    far = [("f1", "bk", 20, "header", "Of the Salt Roads and their Keepers", "", ""), ("f2", "bk", 60, "text", "The garrison was closed.", "", "")]
    seg = [
        ("s1", "bk", None, "paragraph", "The register THE CHRONICLE OF LODLENVEL, NEW EDITION lists 439 entries.", 1),
        ("s2", "bk", None, "paragraph", "The garrison Of the Salt Roads amd their Keepers was closed.", 1),
        ("s3", "bk", None, "paragraph", "The garrison was closed.", 1),
        ("s4", "bk", 60, "paragraph", "The garrison Of the Salt Roads and their Keepers was closed.", 1),
        ("s5", "bk", None, "heading", "The Chronicle of Lodlenvel, new edition", 1),
    ]
    blocks, segments = frames(spark, far, seg)
    noise = {r.record_key: r.noise for r in scan_noise(blocks, segments).where("origin = 'segments'").collect()}
    assert all("running_line" in noise[k] for k in ("s1", "s2", "s4")) and noise["s3"] == noise["s5"] == []


def test_text_without_noise_is_reflowed(spark):
    extra = [("x1", "bk", 3, "text", "The northern garrison\r\nsupported the manuscript.\n\nThe window\nwas closed.", "", "")]
    seg = [("s1", "bk", 4, "table", "| garrison | window |\n|---|---|\n| volume | 439 |", 1)]
    rows = {r.record_key: r for r in scan_noise(*frames(spark, extra, seg), with_text=True).where("record_key in ('x1', 's1')").collect()}
    assert rows["x1"].noise == [] and rows["x1"].clean_text == "The northern garrison supported the manuscript.\n\nThe window was closed."
    assert rows["s1"].clean_text == seg[0][4]


def test_words_beside_decide_between_candidates():
    reader = Reader({"dam": 9, "elam": 50, "the": 500, "held": 40})
    found = [judge(t, None, 1, "paragraph", reader, Furniture([]), Counter(), {"clam"})["misread"] for t in ("The dam held, the clam held.", "The clam held.")]
    assert found == [{"clam": "dam"}, {"clam": "elam"}] and reader.right("elan") is None


def test_single_edits_where_the_context_holds_the_word(spark):
    extra = [(f"c{i}", "bk", 2, "text", f"The {w} was closed. The northern {g} supported the manuscript.", "", "") for i, (w, g) in enumerate([("windox", "garrson"), ("wimdow", "garriison"), ("windowe", "garrison")])]
    extra += [("d", "bk", 2, "text", "Only a windox stood.", "", ""), ("e", "bk", 2, "text", "The Windox was closed.", "", "")]
    rows = {r.record_key: r for r in scan_noise(*frames(spark, extra), with_text=True).where("origin = 'blocks'").collect()}
    assert all(rows[f"c{i}"].noise == ["misread"] and rows[f"c{i}"].clean_text == "The window was closed. The northern garrison supported the manuscript." for i in range(3))
    assert rows["d"].noise == rows["e"].noise == []


def test_confusions_are_learned(spark):
    words = [f"{a}{b}q{c}" for a in ("mar", "gar", "tol", "ben", "sil") for b in ("en", "ol", "ut") for c in ("er", "an", "is")]
    rows = [(w, 500) for w in words] + [(w.replace("q", "zz"), 2) for w in words[:30]] + [("marenquer", 2), ("tolxlqer", 2), ("12", 40)]
    counts = spark.createDataFrame(rows, "word string, n long")
    assert learned_confusions(counts, dict(rows[: len(words)])) == [("zz", "q")]
    known, confusions, sides = vocabulary(counts.union(spark.createDataFrame([("\x01marenqer", 400), ("\x02marenqan", 20)], counts.schema)))
    assert ("zz", "q") in confusions and set(known) == set(words) and sides == {"\x01marenqer"}
    assert Reader(known, confusions).right("silutzzis") == "silutqis" and vocabulary(counts.limit(0)) == ({}, CONFUSIONS, set())


def test_numbers_of_the_text(spark):
    assert page_spans("The register lists 12 entries", 11, 1, [], False) == [(19, 21)]
    assert page_spans("The register lists 12 entries", 11, 1, [], False, {"\x01lists"}) == page_spans("He counted 12 entries", 11, 1, [], False, {"\x02entries"}) == []


def test_short_running_lines(spark):
    extra = [(f"k{i}", "bk", i, "header", "Vorwort", "", "") for i in range(12)] + [("x1", "bk", 3, "text", "The register\nVorwort\nwas closed.", "", ""), ("x2", "bk", 3, "text", "The vorwort was closed.", "", "")]
    seg = [("s1", "bk", None, "paragraph", "The garrison\nVORWORT 12\nwas closed.", 1)]
    noise = {r.record_key: r.noise for r in scan_noise(*frames(spark, extra, seg)).collect()}
    assert noise["x1"] == ["running_line"] and noise["x2"] == [] and noise["s1"] == ["running_line"]


def test_number_and_signs_far_before_a_running_line():
    line = "The Chronicle of Lodlenvel"
    text = "It was closed. 12 " + "-" * 60 + " " + line
    found = Furniture([fold(line)]).spans(text)
    assert without_furniture(text, found, 12).strip() == "It was closed." and without_furniture(text, found, 13).strip() == "It was closed. 12"
    assert without_furniture("the garri- " + line + "son", [(11, 37)], 12) == "the garri- son"


def test_edits_of_the_automaton():
    words = {"window": 9, "winter": 5, "garden": 7, "market": 3, "mark": 2, "windows": 1}
    alphabet = "abdegikmnorstwz"
    for w in words:
        near = {w[:i] + x + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for x in ("", *alphabet)}
        for q in near:
            assert w in Trie(words).near(q, confusions=0, edits=1)
