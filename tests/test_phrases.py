import random

from pyspark.sql import functions as F

from quire.operators import contents, phrases, terms
from quire.operators import terminology as term


def test_every_holder_is_met(spark):
    """Terms at odd places of words, alone or many with one first word: none that stands in a text with its first word is missed."""
    random.seed(3)
    words = ["a", "at", "cat", "Treaty", "entreaty", "of", "lum", "lumka", "lumkammir", "É", "café", "x_1"]
    texts = [(f"s{i}", None if i % 40 == 0 else random.choice([" ", "-", ", "]).join(random.choices(words, k=random.randint(0, 9)))) for i in range(300)]
    terms = sorted({random.choice([" ", "-"]).join(random.choices(words, k=random.randint(1, 4))) for _ in range(300)} | {"", "—", "treaty of lum", "at lum", "cat."})
    got = {tuple(r) for r in phrases.met(spark.createDataFrame(texts, "id string, source_text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    first = {r.w: r.t for r in spark.createDataFrame([(t,) for t in terms], "w string").select("w", phrases.tokens(F.col("w")).alias("t")).collect()}
    split = {r.id: r.t for r in spark.createDataFrame(texts, "id string, x string").where("x is not null").select("id", phrases.tokens(F.col("x")).alias("t")).collect()}
    want = {(i, t) for i, x in texts if x is not None for t in terms if first[t] and first[t][0] in split[i] and t.lower() in x.lower()}
    assert want <= got and want


def test_few_others_are_met(spark):
    """A thousand terms with one first word do not meet the texts that hold that word."""
    terms = spark.range(100, 1100).select(F.concat(F.lit("treaty of "), F.col("id").cast("string")).alias("term"))
    texts = spark.range(100, 1100).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("The treaty of "), F.col("id").cast("string"), F.lit(" and the treaty of peace")).alias("source_text"))
    assert phrases.met(texts, terms).count() < 5_000 and phrases.met(texts.limit(0), terms).count() == 0


def test_concepts_in_any_case(spark):
    """As SQL has it: accented capitals, short words and words after an apostrophe are found."""
    concepts = spark.createDataFrame([("c", 1, ["café noir"], "preferred", "x"), ("s", 2, ["ox"], "preferred", "x"), ("a", 3, ["abbey"], "preferred", "x"), ("e", 4, [r"a\Eb"], "preferred", "x")], "concept_id string, place int, surfaces array<string>, constraint string, translation string")
    pairs = spark.createDataFrame([("1", "1", "Au CAFÉ NOIR", "x"), ("2", "2", "An ox.", "x"), ("3", "3", "Vers l'abbey", "x"), ("4", "4", r"A\EB", "x")], "segment_id string, ordinal string, source_text string, target string")
    assert {(r.segment_id, r.concept_id) for r in term.concept_uses(pairs, concepts).collect()} == {("1", "c"), ("2", "s"), ("3", "a"), ("4", "e")}


def test_success_rate_in_one_pass(spark):
    """Uses and violations as the audit of single terms counts them, with the texts read for one meeting only."""
    pairs = spark.createDataFrame([("1", 1, "Old town and gate", "Old town"), ("2", 2, "The gate", "gate"), ("3", 3, "gateway", ""), ("4", 4, "investigate the gate tower", None)], "segment_id string, ordinal int, source_text string, target string")
    g = spark.createDataFrame([("old town", "Old town", "hard"), ("gate", "gate", "keep"), ("gate tow", "x", "hard")], "term string, translation string, constraint string")
    rate = contents.success_rate(pairs, g)
    assert tuple(rate.first()) == (5, contents.term_audit(pairs, g).count(), 0.8)
    assert rate._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_terms_with_one_first_word(spark):
    """Thousands of terms that begin alike and texts with that word: no join on the first word, all matches."""
    t = spark.range(100, 1100).select(F.concat(F.lit("treaty of "), F.col("id").cast("string")).alias("term"))
    s = spark.range(100, 1100).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("The Treaty – of "), F.col("id").cast("string")).alias("source_text"))
    m = terms.matches(t, s)
    assert m.count() == 1000 and "_first" not in m._jdf.queryExecution().analyzed().toString()


def test_glossary_with_one_first_word(spark):
    """Terms that begin alike do not meet all texts with that word; a term counts within longer words if its first word stands by itself too."""
    g = spark.createDataFrame([(f"gate of {i}",) for i in range(100, 400)] + [("gate tow",), ("gate",)], "term string")
    p = spark.createDataFrame([("1", "Investigate towers at the gate of 123"), ("2", "investigate towers"), ("3", None)], "segment_id string, source_text string")
    used = contents.glossary_in_use(p, g)
    assert {(r.segment_id, r.term, r["rank"]) for r in used.collect()} == {("1", "gate of 123", 1), ("1", "gate tow", 2), ("1", "gate", 3)}
    assert "_w#" not in used._jdf.queryExecution().analyzed().toString()


def test_metrics_count_every_use(spark):
    """Uses in accented capitals and after an apostrophe count in the figures too."""
    concepts = spark.createDataFrame([("c", 1, ["café noir"], "preferred", "x"), ("a", 2, ["abbey"], "hard", "y")], "concept_id string, place int, surfaces array<string>, constraint string, translation string")
    pairs = spark.createDataFrame([("1", "1", "Au CAFÉ NOIR", "x"), ("2", "2", "Vers l'abbey", "x")], "segment_id string, ordinal string, source_text string, target string")
    m = term.terminology_metrics(term.judged_uses(term.concept_uses(pairs, concepts))).first()
    assert (m.applicable, m.matched, m.hard_violations) == (1, 1, 1)
