"""Audit of a glossary of concepts in translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import phrases


def concept_uses(pairs: DataFrame, concepts: DataFrame) -> DataFrame:
    """segment_id, ordinal, target, concept_id, place, constraint, translation, surface, is_first of each concept in each source.

    pairs: segment_id, ordinal, source_text, target; concepts: concept_id, place (order of
    the glossary), surfaces (array), constraint, translation. The first surface of a
    concept that stands in the source as a phrase, whatever its letter case, counts.
    """
    forms = concepts.select("concept_id", "place", "constraint", F.coalesce("translation", F.lit("")).alias("translation"), F.posexplode("surfaces").alias("_k", "surface"))
    near = phrases.met(pairs.select("segment_id", "source_text"), forms.select(F.col("surface").alias("term")), "segment_id").withColumnRenamed("term", "surface")
    sources = pairs.where("source_text is not null").select("segment_id", "ordinal", "source_text", F.coalesce("target", F.lit("")).alias("target"))
    quoted = F.replace(F.lower("surface"), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    phrase = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), quoted, F.lit(r"\E(?![\p{L}\p{N}_])"))
    stands = sources.join(near, "segment_id").where(F.contains(F.lower("source_text"), F.lower("surface"))).where(F.rlike(F.lower("source_text"), phrase))
    met = stands.drop("source_text").join(forms, "surface")
    one = met.groupBy("segment_id", "ordinal", "target", "concept_id", "place", "constraint", "translation").agg(F.min_by("surface", "_k").alias("surface"))
    w = Window.partitionBy("concept_id").orderBy("ordinal", "segment_id")
    return one.withColumn("is_first", F.row_number().over(w) == 1)


def judged_uses(uses: DataFrame) -> DataFrame:
    """uses with check (hard_violation, do_not_translate, first_occurrence, suspicious_context or null), applicable, matched."""
    there = (F.col("translation") != "") & F.contains("target", "translation")
    kept = F.contains("target", "surface")
    hard = (F.col("constraint") == "hard") & (F.col("translation") != "") & ~there
    later = (F.col("constraint") == "first_occurrence") & ~F.col("is_first")
    keep = F.col("constraint") == "do_not_translate"
    bears = ~hard & ~later & ~keep
    doubtful = ~there & ((F.col("constraint") == "sense_constrained") | (F.col("constraint") == "first_occurrence") & (F.col("translation") != ""))
    check = (
        F.when(hard, "hard_violation")
        .when(keep & ~kept, "do_not_translate")
        .when(later & ~kept, "first_occurrence")
        .when(bears & doubtful, "suspicious_context")
    )
    return uses.withColumns({"check": check, "applicable": bears, "matched": bears & there})


def _minority(judged: DataFrame) -> DataFrame:
    """surface, translation of variants other than the one most used; of equally used ones the first."""
    n = judged.where("matched").groupBy("surface", "translation").agg(F.count("*").alias("_n"), F.min(F.struct("ordinal", "segment_id", "place")).alias("_at"))
    w = Window.partitionBy("surface").orderBy(F.desc("_n"), "_at")
    return n.withColumn("_rank", F.row_number().over(w)).where("_rank > 1").select("surface", "translation")


def terminology_flags(judged: DataFrame) -> DataFrame:
    """segment_id, check, severity, concept_id, surface; consistency for each use of a minority variant."""
    severity = F.when(F.col("check").isin("hard_violation", "do_not_translate"), "high").otherwise("flag")
    own = judged.where("check is not null").select("segment_id", "check", severity.alias("severity"), "concept_id", "surface")
    odd = judged.where("matched").join(_minority(judged), ["surface", "translation"], "left_semi")
    return own.unionByName(odd.select("segment_id", F.lit("consistency").alias("check"), F.lit("flag").alias("severity"), "concept_id", "surface"))


def terminology_metrics(judged: DataFrame) -> DataFrame:
    """applicable, matched, term_success_rate (1 if nothing applies), hard_violations, consistency_flags, suspicious_contexts; one row."""
    n, k = F.count_if("applicable"), F.count_if("matched")
    sums = judged.agg(
        n.alias("applicable"), k.alias("matched"), F.when(n == 0, 1.0).otherwise(F.round(k / n, 6)).alias("term_success_rate"),
        F.count_if(F.col("check") == "hard_violation").alias("hard_violations"), F.count_if(F.col("check") == "suspicious_context").alias("suspicious_contexts"),
    )
    return sums.crossJoin(F.broadcast(_minority(judged).agg(F.count("*").alias("consistency_flags"))))
