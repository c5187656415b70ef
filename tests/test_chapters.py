from pyspark.sql import functions as F

from quire.operators import chapters as ch
from quire.operators import terminology as term

N = "id string, book_id string, kind string, level int, title_source string, page_json int, parent_id string"
NODES = [
    ("b", "k", "book", 0, "Book", None, None), ("c1", "k", "chapter", 1, "One", 3, "b"), ("s1", "k", "section", 2, "First", 4, "c1"), ("s2", "k", "section", 3, "Deep", 3, "s1"),
    ("x", "k", "section", 1, "Loose", 9, "b"), ("y", "k", "section", 1, "Ring", 9, "y"), ("x", "k", "section", 1, "Loose", 9, "b"),
]
S = "id string, parent_node_id string, zone string, page_json int, translatable boolean, metadata struct<node_id: string, node_kind: string>"


def test_chapters(spark):
    nodes = spark.createDataFrame(NODES, N)
    got = {r.node_id: (r.chapter_id, r.anchor_id) for r in ch.chapter_ancestors(nodes).collect()}
    assert got == {"b": (None, None), "c1": ("c1", "c1"), "s1": ("c1", "c1"), "s2": ("c1", "c1"), "x": (None, "x"), "y": (None, None)}
    segments = [("1", "s2", "body", 5, True, None), ("2", "b", "body", 3, True, ("c1", "chapter")), ("3", "x", "back", None, True, None), ("4", None, "back", 7, None, None), ("5", "gone", None, 7, True, ("x", "section"))]
    df = spark.createDataFrame(segments, S)
    assert {r.id: r.chapter_id for r in ch.chapter_keys(df, nodes).collect()} == {"1": "c1", "2": "c1", "3": None, "4": None, "5": None}
    rows = {r.chapter_id: (r.title, r.kind, r.first_page, r.last_page, r.section_titles, r.segments, r.translatable) for r in ch.chapter_briefs(df, nodes).collect()}
    assert rows == {"c1": ("One", "chapter", 3, 5, ["Deep", "First"], 2, 2), "zone:back": ("", "zone_bucket", 0, 0, [], 1, 1), "zone:": ("", "zone_bucket", 7, 7, [], 1, 1)}
    assert ch.chapter_ancestors(nodes.limit(0)).count() == 0 and ch.chapter_briefs(df.limit(0), nodes.limit(0)).count() == 0


def test_matching(spark):
    c = spark.createDataFrame([("b1", "k", 3, "one", None), ("b2", "k", 4, "first", None), ("b3", "k", 5, "", "2"), ("b4", "k", None, "one", "2")], "candidate_id string, book_id string, page int, title string, token string")
    n = spark.createDataFrame([("n1", "k", 9, "x", None, "b1"), ("n0", "k", 3, "one", None, None), ("n2", "k", 4, "first", None, None), ("n3", "k", 5, "", "2", None)], "node_id string, book_id string, page int, title string, ordinal string, block_id string")
    assert {tuple(r) for r in ch.first_match(c, n).collect()} == {("b1", "n1", 1), ("b2", "n2", 2), ("b3", "n3", 3)}
    s = "id string, book_id string, block_id string, title string, page int"
    a = spark.createDataFrame([("1", "k", "p", "t", 1), ("2", "k", None, "alone", 2), ("3", "k", None, "twice", 3), ("4", "k", None, "twice", 4)], s)
    b = spark.createDataFrame([("p", "k", "p", "z", 9), ("q", "k", "q", "alone", 8), ("r", "k", "r", "twice", 3), ("s", "k", "s", None, 4)], s)
    assert {tuple(r) for r in ch.identity_match(a, b).collect()} == {("1", "p", 1), ("2", "q", 2), ("3", "r", 3)}


def test_footnotes_and_order(spark):
    b = spark.createDataFrame([("a", "k", 1, 0, "goes on"), ("b", "k", 1, 1, "1 Note"), ("c", "k", 1, 2, "more"), ("d", "k", 1, 3, "2 Other"), ("e", "k", 2, 0, None)], "id string, book_id string, page_index int, block_index int, content string")
    got = [(r.page_index, r.note_no, r.first_id, r.text) for r in ch.joined_footnotes(b, F.col("content").rlike(r"^\d")).orderBy("page_index", "note_no").collect()]
    assert got == [(1, 0, "a", "goes on"), (1, 1, "b", "1 Note more"), (1, 2, "d", "2 Other"), (2, 0, "e", "")]
    nodes = spark.createDataFrame(NODES[:-1], N)
    assert [r.id for r in ch.document_order(nodes).orderBy("place").collect()] == ["b", "c1", "s2", "s1", "x", "y"]
    assert {r.level: (r.rows, r.sample_ids) for r in ch.style_clusters(nodes, 2).collect()}[1] == (3, ["c1", "x"])


def test_terminology_audit(spark):
    concepts = spark.createDataFrame(
        [("h", 1, ["Salt Road"], "hard", "盐路"), ("k", 2, ["Lodlenvel"], "do_not_translate", ""), ("f", 3, ["abbey"], "first_occurrence", "修道院"), ("s", 4, ["mill"], "sense_constrained", "磨坊"), ("p", 5, ["river"], "preferred", "河"), ("q", 6, ["river"], "preferred", "江")],
        "concept_id string, place int, surfaces array<string>, constraint string, translation string",
    )
    pairs = [("1", 1, "The salt road and the abbey.", "盐路和修道院"), ("2", 2, "The Salt Road, the abbey, the mill.", "路 abbey"), ("3", 3, "Lodlenvel by the abbey.", "洛"), ("4", 4, "The river.", "河"), ("5", 5, "River, river.", "河"), ("6", 6, "A river.", "江"), ("7", 7, "millstone", ""), ("8", 8, None, None)]
    judged = term.judged_uses(term.concept_uses(spark.createDataFrame(pairs, "segment_id string, ordinal int, source_text string, target string"), concepts))
    assert {(r.segment_id, r.check, r.severity) for r in term.terminology_flags(judged).collect()} == {
        ("2", "hard_violation", "high"), ("2", "suspicious_context", "flag"), ("3", "do_not_translate", "high"), ("3", "first_occurrence", "flag"), ("6", "consistency", "flag"),
    }
    m = term.terminology_metrics(judged).first()
    assert (m.applicable, m.matched, m.hard_violations, m.suspicious_contexts, m.consistency_flags) == (9, 5, 1, 1, 1) and m.term_success_rate == round(5 / 9, 6)
    none = term.terminology_metrics(judged.limit(0)).first()
    assert none.term_success_rate == 1.0 and none.applicable == 0
