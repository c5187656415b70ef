import itertools
import random

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import alignment, audit, incremental as inc, structure as st, telemetry, terms

PAIR = "segment_id string, kind string, source_text string, target string"


def flags(df):
    return {(r.segment_id, r.check) for r in df.collect()}


def test_planted_errors(spark):
    src = "The Old Stone Bridge was built in 1978 by the city (Vogel 2011). It cost 12% of IV budgets. More text follows here so that it is long."
    rows = [
        ("ok", "paragraph", "A.", "甲。"), ("foot", "paragraph", "A[^fn-1-1] line.", "一行。"), ("url", "paragraph", "See https://a.b/c now.", "见 https://a.b/d 现。"), ("empty", "paragraph", "A line.", " 　"),
        ("year", "paragraph", "In 1978 it was.", "那时。"), ("short", "paragraph", src, "短。"), ("resid", "paragraph", "x", "a b c d e f g h i j"), ("rep", "paragraph", "x", "他去了那里。他去了那里。他去了那里。"),
        ("noun", "paragraph", "seen Great Stone Gate there", "看见"), ("pipe", "table", "| a | b |", "| a b |"), ("d1", "paragraph", "x", "同一句话。"), ("d2", "paragraph", "x", "同一句话。"), ("d3", "paragraph", "x", "同一句话。"),
        ("comment", "paragraph", "a <!-- x --> b", "甲"), ("cite", "paragraph", "a [12] b", "甲 12 乙"),
    ]
    pairs = spark.createDataFrame(rows, PAIR)
    got = flags(audit.all_flags(pairs))
    assert {("foot", "footnotes"), ("url", "urls"), ("empty", "empty"), ("year", "years"), ("year", "numerals"), ("short", "short"), ("short", "length_ratio"), ("resid", "residual"), ("rep", "repeated_sentence"), ("noun", "proper_noun"), ("pipe", "table_delimiters"), ("comment", "structural"), ("cite", "citation_markers")} <= got
    assert {s for s, c in got if c == "duplicate"} == {"d1", "d2", "d3"} and not any(s == "ok" for s, _ in got) and ("foot", "footnote_missing") not in got
    assert flags(audit.all_flags(pairs.limit(0))) == set()
    decided = {(r.segment_id, r.check): r.decision for r in audit.triage(audit.all_flags(pairs), pairs).collect()}
    assert decided[("d1", "duplicate")] == "auto_acceptable_variant" and decided[("rep", "repeated_sentence")] == "needs_human"
    assert audit.human_queue(audit.triage(audit.all_flags(pairs), pairs), 1).first().segment_id == "url"
    kept = audit.replace_stage(audit.all_flags(pairs), audit.parity_flags(pairs).limit(0), "qa-1")
    assert {r.stage for r in kept.select("stage").distinct().collect()} == {"qa-3"}


def test_incremental(spark):
    seg = spark.createDataFrame([("a", "h1", True), ("b", "h2", True), ("c", "h3", True), ("d", "h4", False)], "id string, source_hash string, translatable boolean")
    log = spark.createDataFrame([("a", 1, "old", "completed"), ("a", 5, "h1", "completed"), ("a", 3, "h1", "failed"), ("b", 2, "h0", "completed"), ("z", 9, "h", "completed")], "segment_id string, n long, source_hash string, status string")
    last = inc.latest(log, "segment_id", "n").cache()
    assert {r.segment_id: r.n for r in last.collect()} == {"a": 5, "b": 2, "z": 9}
    assert {r.id for r in inc.pending(seg, last).collect()} == {"b", "c"} and [r.segment_id for r in inc.unknown_rows(seg, last).collect()] == ["z"]
    assert {r.id: r.coverage for r in inc.coverage_class(seg, last).collect()} == {"a": "current", "b": "stale", "c": "missing", "d": "missing"}
    assert inc.coverage(seg, last).first().coverage == round(1 / 3, 6) and inc.coverage(seg.limit(0), last).first().coverage == 1.0
    assert [r.id for r in inc.target_prefix(inc.pending(seg, last), last, 4).collect()] == ["b"]


def test_batches_against_sequential_plan(spark):
    random.seed(4)
    rows, pos = [], 0
    for i in range(200):
        pos += random.choice([1, 1, 1, 1, 2])
        rows.append((f"s{i:03}", f"ch{i // 70}", None if i % 41 == 0 else pos, random.random() < 0.15, random.choice([10, 500, 3000, 7000])))
    want, cur = [], []
    for r in rows:
        if r[2] is None:
            if cur:
                want.append(cur)
            want.append([r])
            cur = []
            continue
        cap = 1 if r[3] else 4
        fits = cur and cur[-1][1] == r[1] and cur[-1][3] == r[3] and r[2] == cur[-1][2] + 1 and len(cur) < cap and sum(x[4] for x in cur) + r[4] <= 6000
        if cur and not fits:
            want.append(cur)
            cur = []
        cur.append(r)
        if len(cur) >= cap or sum(x[4] for x in cur) >= 6000:
            want.append(cur)
            cur = []
    if cur:
        want.append(cur)
    got = inc.plan_batches(spark.createDataFrame(rows, "id string, chapter string, position int, sensitive boolean, size int"))
    by = {}
    for r in got.collect():
        by.setdefault(r.batch, set()).add(r.id)
    assert set(map(frozenset, by.values())) == {frozenset(x[0] for x in b) for b in want}
    s = inc.batch_summary(got).first()
    assert (s.batches, s.segments) == (len(want), 200)


def test_structure(spark):
    h = spark.createDataFrame([("a", "k", 1, 1), ("b", "k", 2, 2), ("c", "k", 3, 4), ("d", "k", 4, 3), ("e", "k", 5, 2), ("f", "k", 6, 1)], "id string, book_id string, seq int, level int")
    assert {r.id: r.parent for r in st.stack_parents(h).collect()} == {"a": None, "b": "a", "c": "b", "d": "b", "e": "a", "f": None}
    p = spark.createDataFrame([("1", "x", "", 1, 1, "It began and con-"), ("2", "x", "", 2, 1, "tinued to"), ("3", "x", "", 3, 1, "the end."), ("4", "x", "", 4, 1, "New one."), ("5", "x", "", 6, 1, "far off")], "id string, parent string, zone string, page int, ordinal int, text string")
    assert {r.first_id: (r.text, r.pieces) for r in st.stitch(p).collect()} == {"1": ("It began and continued to the end.", 3), "4": ("New one.", 1), "5": ("far off", 1)}
    n = spark.createDataFrame([("a", "k", "Title", 1, "m"), ("b", "k", "1 TITLE", 1, "m"), ("c", "k", None, 1, "m")], "id string, book_id string, title_source string, page_json int, zone string")
    surv = st.keep_first(n)
    assert {r.id: r.survivor for r in surv.collect()} == {"a": "a", "b": "a", "c": "c"}
    assert {r.id: r.parent_id for r in st.redirect(n.withColumn("parent_id", F.lit("b")), surv).collect()} == {"a": "a", "c": "a"}
    t = "id string, level int, kind string, parent string"
    d = st.tree_diff(spark.createDataFrame([("a", 1, "x", None), ("b", 2, "x", "a"), ("c", 2, "x", "a")], t), spark.createDataFrame([("a", 1, "x", None), ("b", 3, "x", "q"), ("d", 1, "x", None)], t), ["id"])
    assert {tuple(r) for r in d.collect()} == {("b", "level"), ("b", "parent"), ("c", "removed"), ("d", "added")}
    z = spark.createDataFrame([("k", 1, 1, 1), ("k", 1, 2, 2), ("k", 2, 1, 1)], "book_id string, page int, seq int, level int")
    s = st.zip_score(z, z.limit(2)).first()
    assert (s.matched, s.precision, s.recall, s.level_accuracy) == (2, 0.666667, 1.0, 1.0)
    pages = spark.createDataFrame([(0, {"parsing_res_list": [{"block_id": 1, "block_order": "x", "block_label": "text", "block_content": "b", "block_bbox": [0.0, 9.0, 5.0, 10.0]}, {"block_id": None, "block_order": "1", "block_label": "text", "block_content": "a", "block_bbox": None}]}), (1, {"parsing_res_list": None})],
                                  "page_index int, prunedResult struct<parsing_res_list:array<struct<block_id:long,block_order:string,block_label:string,block_content:string,block_bbox:array<double>>>>")
    flat = st.flatten_pages(pages).orderBy("sort_pos").collect()
    assert [r.content for r in flat] == ["a", "b"] and flat[0].bbox == [0.0] * 4 and flat[0].page_height == 10.0


def test_alignment_against_brute_force(spark):
    random.seed(6)
    for _ in range(25):
        pairs = [(a, b, random.choice([0.5, 0.7, 0.8, 0.9])) for a in range(4) for b in range(4) if random.random() < 0.6]
        got = alignment.monotone(pd.DataFrame(pairs, columns=["left", "right", "score"]), 0.62)
        worth = {(a, b): s - 0.6 for a, b, s in pairs if s >= 0.62}
        best = 0.0
        for k in range(5):
            for c in itertools.combinations(worth, k):
                if all(x[0] < y[0] and x[1] < y[1] for x, y in zip(sorted(c), sorted(c)[1:])):
                    best = max(best, sum(worth[p] for p in c))
        assert abs(sum(worth[p] for p in got) - best) < 1e-9 and all(a < c and b < d for (a, b), (c, d) in zip(got, got[1:]))
    g = spark.createDataFrame([("k", "a", "x", 1.0, 1), ("k", "a", "y", 1.0, 0), ("k", "b", "y", 0.95, 0), ("k", "b", "x", 0.91, 0)], "book_id string, left_id string, right_id string, score double, gap int")
    assert {(r.left_id, r.right_id) for r in alignment.greedy(g).collect()} == {("a", "y"), ("b", "x")}
    rows = spark.createDataFrame([("s1", "k", 1), ("s2", "k", 5), ("s3", "k", 0)], "id string, book_id string, page int")
    heads = spark.createDataFrame([("h1", "k", 1, 0), ("h2", "k", 4, 0)], "head_id string, book_id string, page int, seq int")
    assert {r.id: r.head_id for r in alignment.preceding(rows, heads).collect()} == {"s1": "h1", "s2": "h2", "s3": None}


def test_terms(spark):
    s = spark.createDataFrame([(f"s{i}", "heading" if i == 0 else "paragraph", "Chapter 1 The old town hall" if i == 0 else f"He saw the old town hall of Great Stone Gate and “a quoted phrase” number{i}") for i in range(5)] + [("n", "paragraph", None)], "id string, kind string, source_text string")
    grams = {r.phrase: (r.n, r.segments) for r in terms.ngrams(s).collect()}
    assert grams["old town"] == (5, 5) and "the old" not in grams
    mined = {r.norm: r for r in terms.mine(s).collect()}
    assert "proper_name" in mined["great stone gate"].reasons and "heading_phrase" in mined["the old town hall"].reasons and mined["a quoted phrase"].occurrences == 4
    assert [r.place for r in terms.candidate_queue(terms.mine(s), 3).orderBy("place").collect()] == [1, 2, 3] and terms.candidate_queue(terms.mine(s), 0).count() == len(mined)
    m = terms.matches(spark.createDataFrame([("old–town",), ("town old",), ("",)], "term string"), s)
    assert {tuple(r) for r in m.collect()} == {("old–town", f"s{i}") for i in range(5)}
    master = spark.createDataFrame([("Old Town", 1), ("The old town of", 2)], "term string, ordinal int")
    got = {r.surface: (r.entry, r.how) for r in terms.master_match(spark.createDataFrame([("old town",), ("the old town",), ("x",)], "surface string"), master).collect()}
    assert got == {"old town": ("Old Town", "exact"), "the old town": ("The old town of", "loose"), "x": (None, None)}


def test_telemetry(spark):
    u = spark.createDataFrame([("m", "k1", 1.5, False, 2), ("m", "k1", None, True, None)], "model string, key string, value double, failed boolean, requests long")
    r = telemetry.usage_totals(u, ["model"]).first()
    assert (r.rows, r["keys"], r.total, r.failed, r.requests, r.retry_rate) == (2, 1, 1.5, 1, 3, 0.333333)
    k = spark.createDataFrame([("a",), ("a",), ("b",)], "m string")
    assert [tuple(x) for x in telemetry.message_delta(k.limit(1), k, ["m"]).orderBy("m").collect()][-1] == ("b", 1)
