import random

import pytest
from pyspark.sql import functions as F

from quire.llm.truncation import ending, length_spikes, truncation, truncation_report

ENDINGS = [
    ("He went home.", "terminal"), ("He went to the", "open"), ("他回家了。", "terminal"), ("他回", "open"), ("the r [more]", "marked"), ("the stone\ufffd", "marked"), ("years…", "ellipsis"),
    ("Text.\n- Name, 1706", "list"), ("Text.\n| a | 9 |", "table"), ("Text.\n— M. Name \n", "signature"), ("Text.\nhttps://a.example/b", "address"), ("Text.\nEnd of excerpt", "closing"), ("文。\n节选完", "closing"),
    ("Text.[^fn-1-2]", "terminal"), ("“I went,” ", "open"), ("sagte „so“", "open"), ("He said “so.”", "terminal"), ("(see Name 1650, p.", "open"), ("", "blank"), (" \n", "blank"), (None, None), ("« non »", "open"),
]


@pytest.mark.parametrize("text,kind", ENDINGS)
def test_endings(spark, text, kind):
    assert spark.createDataFrame([(text,)], "t string").select(ending(F.col("t"))).first()[0] == kind


def test_spikes_decide_ellipses(spark):
    random.seed(1)
    rows = [(i, "a", "x" * random.randint(50, 900) + ".") for i in range(400)]
    rows += [(1000 + i, "a", "y" * 499 + "…") for i in range(40)] + [(2000, "a", "z" * 321 + "…"), (2001, "b", "z" * 499 + "…"), (2002, None, None), (2003, None, "He was")]
    rows += [rows[0]]
    df = spark.createDataFrame([(*r, "q", True) for r in rows], "doc_id long, source string, text string, ending string, cut boolean")
    assert {(r.source, r.measure, r.length) for r in length_spikes(df).collect()} == {("a", "chars", 500), ("a", "bytes", 502)}
    judged = truncation(df)
    assert {r.doc_id for r in judged.where("cut").collect()} == {1000 + i for i in range(40)} | {2003} and judged.count() == len(rows)
    report = {r.source: (r.documents, r.cut, r.cut_at_limit) for r in truncation_report(judged).collect()}
    assert report["a"] == (442, 40, 40) and report["b"] == (1, 0, 0) and report[None] == (2, 1, 0)
    assert truncation(df.limit(0)).count() == 0


def test_very_long_text(spark):
    df = spark.createDataFrame([(1, "a", "word " * 400_000 + "and")], "doc_id long, source string, text string")
    assert truncation(df).first().cut


def test_closing_remarks_are_learned(spark):
    texts = [f"Text number {'abcdefgh'[i]} is told.\nHier endet der Auszug" for i in range(4)] + ["Other.\nSo he went to"] * 4 + ["Other.\nSo she went", "So she went"]
    df = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    got = {r.doc_id: (r.ending, r.cut, r.cause) for r in truncation(df).collect()}
    assert all(got[i] == ("closing", False, None) for i in range(4)) and all(got[i] == ("open", True, "transfer") for i in range(4, 10))


def test_causes(spark):
    rows = [(i, "a", "x" * (40 + 7 * i) + ".") for i in range(100)] + [(1000 + i, "a", "y" * 499 + "z") for i in range(40)] + [(2000, "a", "He was")]
    judged = truncation(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    assert {(r.cause, r["count"]) for r in judged.where("cut").groupBy("cause").count().collect()} == {("limit", 40), ("transfer", 1)}
    assert [(r.cut_at_limit, r.cut_in_transfer) for r in truncation_report(judged).collect()] == [(40, 1)]
