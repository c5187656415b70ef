"""Quality audit of translations: count parity, anomalies, duplicates, triage.

All checks are columns over one row per pair, made long by one ``inline``; only
duplicates need a shuffle, on a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx

#: What is counted in sources and targets.
FOOTNOTE_REF = r"\[\^[^\]]+\]"
FORMULA = r"\$\s*\^\{?\d+\}?\s*\$"
URL = r"https?://\S+"
COMMENT = r"<!--.*?-->"
PAREN_YEAR = r"\([^)]*(?<![\p{L}\p{N}_])(?:19|20)\d{2}(?![\p{L}\p{N}_])[^)]*\)"
BRACKETED = r"\[\d+(?:[,;]\s*\d+)*\]"
YEARS = r"(?<!\d)(?:19|20)\d{2}(?!\d)|(?<![\p{L}\p{N}_])\d{1,4}\s*(?:BCE?|CE)(?![\p{L}\p{N}_])"
NUMERALS = r"(?<!\d)\d+(?:[.,]\d+)*(?!\d)"
PERCENTAGES = r"(?<!\d)\d+(?:\.\d+)?\s*%"
STRUCTURAL = "|".join([FOOTNOTE_REF, COMMENT, URL, FORMULA])
HIGH = ["structural", "footnotes", "urls", "formulas", "table_delimiters"]


def count(c: Column, pattern: str) -> Column:
    """Matches of a pattern."""
    return F.regexp_count(c, F.lit(pattern))


def _flag(stage: str, name: Column, severity: Column, expected: Column, actual: Column, when: Column) -> Column:
    return F.when(
        when,
        F.struct(F.lit(stage).alias("stage"), name.alias("check"), severity.alias("severity"), expected.cast("int").alias("expected"), actual.cast("int").alias("actual")),
    )


def parity_array() -> Column:
    """Flags of every count that differs, as an array of (stage, check, severity, expected, actual).

    Over the columns kind, source_text, target. The structural family gives at
    most one flag, named after the first of its classes that differs.
    """
    s, t = F.col("source_text"), F.col("target")

    def both(pattern: str) -> tuple[Column, Column]:
        return count(s, pattern), count(t, pattern)

    def flag(name: str, left: Column, right: Column, when: Column) -> Column:
        return _flag("qa-1", F.lit(name), F.lit("high" if name in HIGH else "flag"), left, right, when)

    (sn, tn), (su, tu), (sf, tf) = both(FOOTNOTE_REF), both(URL), both(FORMULA)
    ss, ts = both(STRUCTURAL)
    family = ss != ts
    first = F.when(sn != tn, "footnotes").when(su != tu, "urls").when(sf != tf, "formulas").otherwise("structural")
    source_urls, target_urls = F.array_distinct(tx.urls(s)), F.array_distinct(tx.urls(t))
    sets_differ = (F.size(F.array_except(source_urls, target_urls)) > 0) | (F.size(F.array_except(target_urls, source_urls)) > 0)
    named = lambda x: family & (first == x)
    cite = [count(x, PAREN_YEAR) + count(x, BRACKETED) for x in (s, t)]
    roman = [F.size(tx.roman_tokens(x)) for x in (s, t)]
    pipes = [count(x, r"\|") for x in (s, t)]
    flags = [
        _flag("qa-1", first, F.lit("high"), ss, ts, family),
        flag("urls", F.size(tx.urls(s)), F.size(tx.urls(t)), sets_differ & ~named("urls")),
        flag("footnotes", sn, tn, (sn != tn) & ~named("footnotes")),
        flag("formulas", sf, tf, (sf != tf) & ~named("formulas")),
        flag("citation_markers", *cite, cite[0] != cite[1]),
        *[flag(n, *both(p), both(p)[0] != both(p)[1]) for n, p in (("years", YEARS), ("numerals", NUMERALS), ("percentages", PERCENTAGES))],
        flag("roman_numerals", *roman, roman[0] != roman[1]),
        flag("table_delimiters", *pipes, (F.col("kind") == "table") & (pipes[0] != pipes[1])),
    ]
    return F.array_compact(F.array(*flags))


def parity_flags(pairs: DataFrame) -> DataFrame:
    """segment_id, stage, check, severity, expected, actual of every count that differs; pairs: segment_id, kind, source_text, target."""
    return pairs.select("segment_id", F.inline(parity_array()))


def repeated_sentences(c: Column) -> Column:
    """Sentences of at least four characters that a text has three times or more."""
    parts = F.filter(F.transform(F.split(c, "[。！？!?；;]+"), lambda x: F.lower(tx.squeeze(x))), lambda x: F.length(x) >= 4)
    return F.filter(F.array_distinct(parts), lambda x: F.size(F.filter(parts, lambda y: y == x)) >= 3)


def anomaly_array(least_ratio: float = 0.5, most_residual: int = 8) -> Column:
    """Anomalies of single pairs in the form of parity_array; an empty target has no other anomaly."""
    s, t = F.col("source_text"), F.col("target")
    empty = F.regexp_replace(t, r"[\s\x{3000}\x{00A0}]+", "") == ""
    lost = F.filter(tx.capitalized_runs(s), lambda x: ~tx.span_survives(x, t))

    def flag(name: str, when: Column, severity: str = "flag") -> Column:
        return _flag("qa-3", F.lit(name), F.lit(severity), F.lit(1), F.lit(0), when)

    return F.array_compact(F.array(
        flag("empty", empty, "high"),
        flag("length_ratio", ~empty & (F.length(s) > 0) & (F.length(t) / F.length(s) < least_ratio)),
        flag("short", ~empty & (F.length(t) < 8) & (F.length(s) > 64)),
        flag("residual", ~empty & (tx.residual_run(t) > most_residual)),
        flag("proper_noun", ~empty & (F.size(lost) > 0)),
        flag("repeated_sentence", ~empty & (F.size(repeated_sentences(t)) > 0)),
    ))


def duplicate_flags(pairs: DataFrame, more_than: int = 2) -> DataFrame:
    """Pairs whose target stands on more than two segments; counted per text, joined back."""
    texts = pairs.where(F.regexp_replace("target", r"[\s\x{3000}\x{00A0}]+", "") != "")
    many = texts.groupBy("target").agg(F.count("*").cast("int").alias("actual")).where(F.col("actual") > more_than)
    return texts.join(many, "target").select(
        "segment_id", F.lit("qa-3").alias("stage"), F.lit("duplicate").alias("check"), F.lit("flag").alias("severity"), F.lit(1).alias("expected"), "actual"
    )


def footnote_missing(parity: Column) -> Column:
    """Lost footnote marks of a pair that has no parity flag of any kind, as an array of at most one flag."""
    s, t = count(F.col("source_text"), FOOTNOTE_REF), count(F.col("target"), FOOTNOTE_REF)
    return F.array_compact(F.array(_flag("qa-3", F.lit("footnote_missing"), F.lit("high"), s, t, (s > t) & (F.size(parity) == 0))))


def all_flags(pairs: DataFrame) -> DataFrame:
    """Flags of all stages: those of single pairs in one pass, duplicates by an aggregate over the targets."""
    single = pairs.withColumn("_parity", parity_array()).select("segment_id", F.inline(F.concat("_parity", anomaly_array(), footnote_missing(F.col("_parity")))))
    return single.unionByName(duplicate_flags(pairs))


def replace_stage(flags: DataFrame, fresh: DataFrame, stage: str) -> DataFrame:
    """A report with the flags of one stage replaced by those of a partial run."""
    return flags.where(F.col("stage") != stage).unionByName(fresh.where(F.col("stage") == stage))


def triage(flags: DataFrame, pairs: DataFrame) -> DataFrame:
    """decision of each flag: auto_acceptable_variant, auto_pass or needs_human."""
    s, t = F.col("source_text"), F.col("target")
    han = t.rlike("[㐀-鿿]")
    note = F.col("kind").isin("footnote", "caption")
    open_paren = t.contains("(") | t.contains("（")
    numeric = F.col("check").isin("years", "numerals", "roman_numerals", "percentages")
    shown = (F.trim(t) != "") & (t.rlike("[〇一二三四五六七八九十百千万亿零年月卷部分]") | t.rlike(r"\d"))
    furniture = F.lower(s).rlike("further reading|conclusions|references|bibliography")
    accept = (
        ((F.col("stage") == "qa-1") & numeric & shown)
        | ((F.col("check") == "citation_markers") & note & han & (t.contains("年") | open_paren))
        | ((F.col("check") == "length_ratio") & han & (F.length(t) / F.greatest(F.length(s), F.lit(1)) >= 0.12))
        | ((F.col("check") == "proper_noun") & han & (note | open_paren | (F.length(s) < 80)))
        | ((F.col("check") == "duplicate") & ((F.length(t) <= 40) | furniture))
        | ((F.col("check") == "residual") & note & han & open_paren)
    )
    kept = F.size(F.array_except(tx.urls(s), tx.urls(t))) == 0
    decision = F.when((F.col("stage") == "qa-1") & (F.col("check") == "urls") & kept, "auto_pass").when(accept, "auto_acceptable_variant").otherwise("needs_human")
    return flags.join(pairs.select("segment_id", "kind", "source_text", "target"), "segment_id").select("segment_id", "stage", "check", decision.alias("decision"))


#: How urgent a check is for a reader.
PRIORITY = {"urls": 100, "repeated_sentence": 95, "consistency": 90, "duplicate": 85, "residual": 80, "citation_markers": 75, "roman_numerals": 70, "years": 70, "numerals": 70, "percentages": 70, "proper_noun": 60}


def human_queue(decided: DataFrame, most: int = 20) -> DataFrame:
    """segment_id, checks, priority, place of the most urgent segments; a top-k report."""
    p = F.lit(50)
    for k, v in PRIORITY.items():
        p = F.when(F.col("check") == k, v).otherwise(p)
    per = decided.where(F.col("decision") == "needs_human").groupBy("segment_id").agg(F.max(p).alias("priority"), F.array_sort(F.collect_set("check")).alias("checks"))
    top = per.orderBy(F.desc("priority"), "segment_id").limit(most)
    return top.select("segment_id", "checks", "priority", F.row_number().over(Window.orderBy(F.desc("priority"), "segment_id")).alias("place"))
