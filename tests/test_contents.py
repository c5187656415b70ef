from pyspark.sql import functions as F

from quire.operators import contents as ct


def test_entries(spark):
    lines = [("k", 1, "Preface ..... ix"), ("k", 2, "Part One: The town"), ("k", 3, "and its gates .... 12"), ("k", 4, "1 Origins 15"), ("k", 5, "1 Origins 15"), ("k", 6, None), ("k", 7, "Index … 301")]
    got = [(r.title, r.page_label, r.print_page, r.kind) for r in ct.parse_entries(spark.createDataFrame(lines, "book_id string, seq int, line string")).orderBy("entry_index").collect()]
    assert got == [("Preface", "ix", None, "front"), ("Part One: The town and its gates", "12", 12, "part"), ("1 Origins", "15", 15, "chapter"), ("Index", "301", 301, "back")]
    s = "book_id string, ordinal int, title string, page_label string"
    parsed = spark.createDataFrame([("k", 1, "Origins of the old town", "15"), ("k", 2, "Origins of the old town", "99"), ("k", 3, "Something else", "20")], s)
    merged = ct.merge_entries(parsed, spark.createDataFrame([("k", 1, "Origins of the old town", None), ("k", 2, "The origins of the old town", None)], s))
    assert sorted((r.origin, r.title, r.page_label) for r in merged.collect()) == [("confirmed", "Origins of the old town", "15"), ("confirmed", "The origins of the old town", "99"), ("parsed", "Something else", "20")]


def test_trees(spark):
    h = [("p", "k", 1, "part", None), ("c", "k", 2, "chapter", ["1"]), ("a", "k", 3, "section", ["1", "1"]), ("b", "k", 4, "section", ["1", "1", "2"]), ("x", "k", 5, "section", ["9", "9"]), ("d", "k", 6, "chapter", ["2"]), ("e", "k", 7, "section", ["1", "1", "3"])]
    got = {r.id: r.parent for r in ct.numbered_parents(spark.createDataFrame(h, "id string, book_id string, seq int, kind string, path array<string>")).collect()}
    assert got == {"p": None, "c": "p", "a": "c", "b": "a", "x": "c", "d": "p", "e": "d"}
    placed = spark.createDataFrame([("r", ["r"]), ("p", ["r", "p"]), ("c", ["r", "p", "c"]), ("s", ["r", "p", "c", "s"]), ("q", ["r", "q"])], "node_id string, path array<string>")
    kinds = spark.createDataFrame([("r", "book"), ("p", "part"), ("c", "chapter"), ("s", "section"), ("q", "chapter")], "id string, kind string")
    assert {r.id: r.level for r in ct.normal_levels(placed, kinds).collect()} == {"r": 1, "p": 2, "c": 3, "s": 4, "q": 2}
    c = spark.createDataFrame([("k", p, "main" if p < 50 else "notes") for p in range(0, 100, 2)], "book_id string, page int, zone string")
    assert [(r.first_page, r.last_page) for r in ct.page_windows(c).orderBy("window_no").collect()] == [(0, 38), (40, 78), (80, 98)]


def test_tokens_and_glossary(spark):
    p = spark.createDataFrame([("s1", 1, "paragraph", "The Old Town and a gate [^fn-1-1] https://a.b/c", "老城 [^fn-1-1] https://a.b/c。"), ("s2", 2, "table", "| old town |", "| 老城"), ("s3", 3, "paragraph", "Old towns", "x")], "segment_id string, ordinal int, kind string, source_text string, target string")
    assert {r.segment_id: (r.same_tokens, r.same_pipes) for r in ct.token_order(p).collect()} == {"s1": (True, True), "s2": (True, False), "s3": (True, True)}
    g = spark.createDataFrame([("old town", "老城", "hard"), ("gate", "门", "preferred"), ("town", "镇", "preferred"), ("Old Town", "x", "keep")], "term string, translation string, constraint string")
    assert [r.term for r in ct.glossary_in_use(p, g, 1).where("segment_id = 's1'").collect()] == ["Old Town"]
    got = {(r.segment_id, r.term, r.check) for r in ct.term_audit(p, g).collect()}
    assert ("s1", "gate", "first_occurrence") in got and ("s2", "town", "suspicious_context") in got and ("s1", "Old Town", "do_not_translate") in got and not any(t == "old town" and s != "s3" for s, t, _ in got)
    assert ct.success_rate(p.limit(0), g).first().rate == 1.0
    df = spark.createDataFrame([("⟦b⟧x⟦i⟧y⟦/i⟧⟦/b⟧⟦br/⟧", True), ("⟦b⟧x⟦i⟧y⟦/b⟧⟦/i⟧", False), ("⟦b⟧x", False), ("x", True), ("x⟦/b⟧", False)], "t string, ok boolean")
    assert df.where(ct.balanced(F.col("t")) == F.col("ok")).count() == 5
    senses = spark.createDataFrame([([("a", "x", 3), ("default", "y", 1)],), ([("a", "x", 3), ("b", "z", 2)],)], "s array<struct<sense_id:string,translation:string,version:int>>")
    assert [r[0].translation for r in senses.select(ct.governing_sense(F.col("s"))).collect()] == ["y", "x"]
