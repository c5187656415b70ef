"""Terminology: mining, queues, matching, glossary compilation, metrics.

Texts are tokenized once into arrays; n-grams are slices of them. Terms meet
segments by a pair of neighbouring words that few terms have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import phrases
from quire.runtime import numbered

WORD = r"[A-Za-zÀ-ÖØ-öø-ÿĀ-ž][A-Za-zÀ-ÖØ-öø-ÿĀ-ž’'\-]{2,}"
#: Words no term begins or ends with, headings that are no terms, tiers of the signals.
STOPWORDS = (
    "the and for that this with from into over under was were are has have had not but his her their its our who which when what where than then also only between through about after "
    "before these those there they them can could would should will may might one two first new"
).split()
GENERIC = ["contents", "introduction", "conclusion", "notes", "bibliography", "references", "acknowledgements", "acknowledgments", "index", "preface", "foreword", "further reading", "conclusions"]
TIERS = {"book_title_term": 0, "manually_seeded_source_term": 0, "heading_phrase": 1, "heading_subphrase": 1, "distinctive_word": 2, "quoted_phrase": 3, "proper_name": 4, "repeated_phrase": 5}
WEIGHTS = {"heading_phrase": 60, "heading_subphrase": 35, "quoted_phrase": 20, "proper_name": 15, "distinctive_word": 2}


def words(c: Column) -> Column:
    """Words of at least three letters."""
    return F.regexp_extract_all(c, F.lit(WORD), 0)


def ngrams(segments: DataFrame, sizes: tuple[int, ...] = (2, 3), least: int = 4) -> DataFrame:
    """phrase, n, segments: 2- and 3-grams that neither begin nor end with a stopword, occurring often enough."""
    t = F.transform(words(F.col("source_text")), lambda x: F.lower(x))
    rows = segments.where("source_text is not null").select("id", t.alias("t"))

    def of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("t") - (k - 1))
        return F.when(F.size("t") >= k, F.transform(starts, lambda i: F.slice("t", i, F.lit(k)))).otherwise(F.array().cast("array<array<string>>"))

    grams = F.flatten(F.array(*map(of, sizes)))
    g = rows.select("id", F.explode(grams).alias("g")).where(~F.try_element_at("g", F.lit(1)).isin(STOPWORDS) & ~F.try_element_at("g", F.lit(-1)).isin(STOPWORDS))
    return g.groupBy(F.array_join("g", " ").alias("phrase")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("segments")).where(F.col("n") >= least)


def clean_term(c: Column) -> Column:
    """A candidate without punctuation at its ends, blanks collapsed."""
    return F.regexp_replace(tx.squeeze(c), r"^[ .,;:!?()\[\]{}]+|[ .,;:!?()\[\]{}]+$", "")


def mine(segments: DataFrame, least: int = 4) -> DataFrame:
    """norm, term, reasons, occurrences, score: candidates of six signals over the segments.

    Headings and their parts, quotations, runs of capitalized words, long or
    hyphenated words, and repeated n-grams; each occurrence adds its signal's weight,
    a repeated n-gram up to three times its count, at most thirty.
    """
    s = segments.where("source_text is not null").select("id", "kind", tx.squeeze(F.col("source_text")).alias("t"))
    heading = F.regexp_replace("t", r"(?i)^\s*(?:(?:part|chapter|section|book)\s+)?(?:\d+|[ivxlcdm]+)[.):-]?\s+", "")
    n_words = lambda c: F.size(words(c))

    def signal(rows: DataFrame, term: Column, reason: str) -> DataFrame:
        return rows.select("id", term.alias("raw")).select("id", "raw", F.lit(reason).alias("reason"), F.lit(WEIGHTS[reason]).alias("weight"))

    parts = s.where("kind = 'heading'").select("id", F.explode(F.split(heading, r"(?i)\s*[:;,]\s*|\s+and\s+")).alias("p"))
    quoted = s.select("id", F.explode(F.regexp_extract_all("t", F.lit("[\"“‘]([^\"”’]{3,80})[\"”’]"), 1)).alias("p"))
    names = s.select("id", F.explode(tx.capitalized_runs(F.col("t"))).alias("p"))
    long = s.select("id", F.explode(words(F.col("t"))).alias("p")).where((F.col("p").contains("-") | (F.length("p") >= 12)) & ~F.lower("p").isin(STOPWORDS))
    grams = ngrams(segments, least=least).select(F.col("phrase").alias("raw"), F.lit("repeated_phrase").alias("reason"), (F.least(F.lit(3), "segments") * F.least(F.lit(30), "n")).alias("weight"))
    rows = (
        signal(s.where("kind = 'heading'"), heading, "heading_phrase")
        .unionByName(signal(parts.where(n_words(F.col("p")).between(1, 5)), F.col("p"), "heading_subphrase"))
        .unionByName(signal(quoted.where(n_words(F.col("p")).between(1, 8)), F.col("p"), "quoted_phrase"))
        .unionByName(signal(names.where(n_words(F.col("p")).between(2, 5)), F.col("p"), "proper_name"))
        .unionByName(signal(long, F.col("p"), "distinctive_word"))
        .unionByName(grams.select(F.lit(None).cast("string").alias("id"), "raw", "reason", "weight"))
    )
    term = clean_term(F.col("raw"))
    norm = tx.term_normal(term)
    ok = (F.length("norm") >= 4) & (F.size(words(F.col("term"))) <= 8) & ~F.col("norm").isin(GENERIC) & ~F.col("term").rlike(r"(?i)^(?:\d{2,4}(?:\s+(?:bce|ce))?|\d{2,4}\s+years?\s+ago)$")
    return (
        rows.select("id", term.alias("term"), norm.alias("norm"), "reason", "weight").where(ok)
        .groupBy("norm")
        .agg(F.min_by("term", F.struct(F.length("term"), "term")).alias("term"), F.array_sort(F.collect_set("reason")).alias("reasons"), F.count_distinct("id").alias("occurrences"), F.sum("weight").cast("long").alias("score"))
    )


def tier(reasons: Column) -> Column:
    """Rank of a candidate by its best signal."""
    t = F.lit(5)
    for name, k in sorted(TIERS.items(), key=lambda x: -x[1]):
        ok = F.array_contains(reasons, name)
        t = F.when(ok & (F.col("occurrences") >= 2) if name == "distinctive_word" else ok, k).otherwise(t)
    return t


def candidate_queue(mined: DataFrame, limit: int = 80) -> DataFrame:
    """norm, place of the first candidates by tier, score, occurrences; a limit of 0 keeps all."""
    order = [tier(F.col("reasons")), F.desc("score"), F.desc("occurrences"), F.col("norm")]
    if limit > 0:
        return mined.orderBy(*order).limit(limit).select("norm", F.row_number().over(Window.orderBy(*order)).alias("place"))
    return numbered(mined, *order).select("norm", F.col("place").cast("int").alias("place"))


def matches(terms: DataFrame, segments: DataFrame) -> DataFrame:
    """term, id of every segment that holds the term as a phrase; terms: term."""
    near = phrases.met(segments.select("id", "source_text"), terms.select("term"))
    return segments.join(near, "id").where(F.regexp_like("source_text", tx.phrase_pattern(F.col("term")))).select("term", "id").distinct()


def master_match(surfaces: DataFrame, master: DataFrame) -> DataFrame:
    """surface, entry, how: glossary entry by exact normal form, else by the form without short words; first entry wins."""
    exact = master.groupBy(tx.term_normal(F.col("term")).alias("_k")).agg(F.min_by("term", "ordinal").alias("_exact")).where("_k <> ''")
    loose = master.groupBy(tx.join_normal(F.col("term")).alias("_j")).agg(F.min_by("term", "ordinal").alias("_loose")).where("_j <> ''")
    met = surfaces.withColumns({"_k": tx.term_normal(F.col("surface")), "_j": tx.join_normal(F.col("surface"))}).join(exact, "_k", "left").join(loose, "_j", "left")
    return met.select("surface", F.coalesce("_exact", "_loose").alias("entry"), F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_loose").isNotNull(), "loose").alias("how"))


def primary_window(evidence: DataFrame, windows: DataFrame) -> DataFrame:
    """candidate, window_id, hits: the window with most evidence segments, ties to the earlier one.

    evidence: candidate, segment_id; windows: segment_id, window_id, idx.
    """
    per = evidence.join(windows, "segment_id").groupBy("candidate", "window_id", "idx").agg(F.count_distinct("segment_id").alias("hits"))
    best = per.groupBy("candidate").agg(F.max(F.struct("hits", (-F.col("idx")).alias("i"), "window_id")).alias("b"))
    return best.select("candidate", F.col("b.window_id").alias("window_id"), F.col("b.hits").alias("hits"))


def known_recall(known: DataFrame, mined: DataFrame, queued: DataFrame, retained: DataFrame) -> DataFrame:
    """surface, stage: how far each known term came (lost_mining, lost_queue, lost_retention or retained), by normal form."""
    key = tx.term_normal(F.col("surface"))
    out = known.select("surface", key.alias("_k"))
    for name, t in (("m", mined), ("q", queued), ("r", retained)):
        out = out.join(t.select(tx.term_normal(F.col("surface")).alias("_k")).distinct().withColumn(f"_{name}", F.lit(True)), "_k", "left")
    stage = F.when(F.col("_m").isNull(), "lost_mining").when(F.col("_q").isNull(), "lost_queue").when(F.col("_r").isNull(), "lost_retention").otherwise("retained")
    return out.select("surface", stage.alias("stage"))


def compile_concepts(candidates: DataFrame) -> DataFrame:
    """concept_id, canonical, surfaces, evidence: candidates merged by normal form; null surfaces are left out."""
    norm = tx.term_normal(F.col("surface"))
    return (
        candidates.where(F.col("surface").isNotNull() & (norm != "")).groupBy(norm.alias("norm"))
        .agg(F.min("surface").alias("canonical"), F.array_sort(F.collect_set("surface")).alias("surfaces"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_segment_ids")))).alias("evidence"))
        .select(F.concat(F.lit("concept-"), F.left(F.sha2("norm", 256), F.lit(12))).alias("concept_id"), "canonical", "surfaces", F.size("evidence").alias("evidence"))
    )


def shared_surfaces(candidates: DataFrame) -> DataFrame:
    """norm, books: normal forms that several books have."""
    norm = tx.term_normal(F.col("surface"))
    return candidates.where("surface is not null").groupBy(norm.alias("norm")).agg(F.count_distinct("book_id").alias("books")).where("books > 1")


def mining_metrics(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """candidates, segments, per_segment, multiword_share, single_evidence_share; one row, rates of nothing are 0."""
    c = candidates.agg(
        F.count("*").alias("candidates"), F.count_if(F.col("surface").contains(" ")).alias("_m"), F.count_if(F.size(F.array_distinct("evidence_segment_ids")) == 1).alias("_s")
    )
    s = segments.agg(F.count_distinct("id").alias("segments"))
    rate = lambda a, b: F.round(F.when(b == 0, 0.0).otherwise(a / b), 4)
    return c.crossJoin(s).select("candidates", "segments", rate(F.col("candidates"), F.col("segments")).alias("per_segment"), rate(F.col("_m"), F.col("candidates")).alias("multiword_share"), rate(F.col("_s"), F.col("candidates")).alias("single_evidence_share"))


def source_type_counts(candidates: DataFrame) -> DataFrame:
    """source_type, candidates, occurrences, evidence."""
    return candidates.groupBy("source_type").agg(F.count("*").alias("candidates"), F.coalesce(F.sum("occurrences"), F.lit(0)).alias("occurrences"), F.sum(F.greatest(F.coalesce(F.size("evidence_segment_ids"), F.lit(0)), F.lit(0))).alias("evidence"))


def review_rank(candidates: DataFrame, low: float = 0.5) -> DataFrame:
    """candidate_id, rank: 1 for a low score, 2 for several variants, 3 for no evidence; others need no review."""
    rank = F.when(F.coalesce("score", F.lit(0.0)) < low, 1).when(F.coalesce(F.size("variants"), F.lit(0)) > 1, 2).when(F.coalesce(F.size("evidence_segment_ids"), F.lit(0)) <= 0, 3)
    return candidates.select("candidate_id", rank.alias("rank")).where("rank is not null")
