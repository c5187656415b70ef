from pyspark.sql import functions as F

from quire.llm.term_frequency import frequencies, merge_bitmaps, positions, term_bitmaps, term_frequency
from quire.llm.text import one_form

SCHEMA = "candidate_id string, surface string, occurrences int, evidence_segment_ids array<string>, term string, records int, mark string"
ROWS = [
    ("c1", "Café  Noir", 3, ["s1", "s2", "s2"], "x", 1, "m"),
    ("c1", "Café  Noir", 3, ["s1", "s2", "s2"], "x", 1, "m"),
    ("c2", "cafe\u0301 noir", 4, ["s2", "s3", None], "x", 1, "m"),
    ("c3", "post–war", None, None, "x", 1, "m"),
    ("c4", "post-war\u200b", 1, [], "x", 1, "m"),
    ("c5", None, 9, ["s1"], "x", 1, "m"),
    (None, "lone", 5, ["s9"], "x", 1, "m"),
    (None, "lone", 5, ["s9"], "x", 1, "m"),
]


def run(spark, rows, ids=("s1", "s2", "s3", "s3", None), **kw):
    c = spark.createDataFrame(rows, SCHEMA)
    r = spark.createDataFrame([(i, "e") for i in ids], "id string, range_no string")
    return {x["term"]: (x["occurrences"], x["records"], x["mark"]) for x in term_frequency(c, r, **kw).collect()}


def test_counts_forms_once_and_marks(spark):
    got = run(spark, ROWS, rare_below=5, common_above=0.5)
    assert got == {"café noir": (7, 3, "common"), "post-war": (1, 0, "rare"), "lone": (5, 1, None)}


def test_empty_tables(spark):
    assert run(spark, []) == {}
    assert run(spark, ROWS[:1], ids=())["café noir"] == (3, 2, "rare")


def test_bitmaps_merge_by_union(spark):
    entries = spark.createDataFrame([(f"t{i % 3}", 1, f"r{i % 97}") for i in range(2000)], "term string, occurrences long, record_id string")
    d = positions(entries.select("record_id", F.lit(1).alias("known"))).cache()
    whole = {tuple(r) for r in frequencies(term_bitmaps(entries, d)).collect()}
    parts = [term_bitmaps(entries.where(f"hash(record_id) % 2 = {k}"), d) for k in (0, 1, -1)]
    assert {tuple(r) for r in frequencies(merge_bitmaps(*parts)).collect()} == whole
    brute = entries.groupBy("term").agg(F.sum("occurrences"), F.count_distinct("record_id"))
    assert {tuple(r) for r in brute.collect()} == whole


def test_one_form(spark):
    rows = [("A\u00a0 B",), ("it’s",), ("x\u2011y",), ("É",), ("e\u0301\u200b",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(one_form(F.col("s"))).collect()]
    assert got == ["a b", "it's", "x-y", "é", "é", None, ""]
