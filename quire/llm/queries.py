"""Queries of the training-data problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.markup import markup_residue
from quire.llm.packing import fill_report, pack
from quire.llm.pair_defects import pair_defects, translation_pairs
from quire.llm.repeated_lines import repeated_lines, without_lines
from quire.llm.scan_noise import scan_noise
from quire.llm.term_frequency import term_frequency
from quire.llm.text import APOSTROPHES, DASHES, ZERO_WIDTH
from quire.llm.tokens import encode_corpus, token_count
from quire.llm.truncation import truncation, truncation_report
from quire.runtime import spread, table

#: Wanted and source language of qa_planted_errors.
PLANTED = ("zh", "en")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    return term_frequency(table(spark, d, "term_candidates"), table(spark, d, "segments"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms that are rare or common."""
    return p1_frequencies(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines printed excessively in their book."""
    return repeated_lines(table(spark, d, "blocks")).select("block_id", F.col("line_no").cast("int").alias("line_no"))


def p2_content(spark: SparkSession, d: str) -> DataFrame:
    """Each block's content without such lines."""
    blocks = table(spark, d, "blocks").select("id", "book_id", "page_index", "content")
    return without_lines(blocks, repeated_lines(blocks)).select("id", "clean_content").distinct()


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    planted = table(spark, d, "qa_planted_errors").select(
        F.lit("qa_planted_errors").alias("origin"),
        F.col("id").alias("record_key"),
        "source_text",
        "translated_text",
        F.lit(PLANTED[0]).alias("target_lang"),
        F.lit(PLANTED[1]).alias("lang"),
    )
    log = translation_pairs(spread(table(spark, d, "translations")), table(spark, d, "segments"), table(spark, d, "books"))
    return log.unionByName(planted)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with their defect."""
    judged = pair_defects(_pairs(spark, d), source_lang=F.col("lang"))
    return judged.where(F.col("defect").isNotNull()).groupBy("origin", "record_key").agg(F.min("defect").alias("defect"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of scan noise in each record."""
    noise = scan_noise(table(spark, d, "blocks"), table(spark, d, "segments"))
    return noise.select("origin", "record_key", F.explode("noise").alias("noise")).distinct()


def p5_text(spark: SparkSession, d: str) -> DataFrame:
    """Each record as continuous paragraphs."""
    return scan_noise(table(spark, d, "blocks"), table(spark, d, "segments"), with_text=True).select("origin", "record_key", "clean_text")


def _marked_up(spark: SparkSession, d: str, with_text: bool) -> DataFrame:
    segments = table(spark, d, "segments").select(
        F.lit("segments").alias("origin"), F.col("id").alias("record_key"), F.col("source_text").alias("text"), (F.col("kind") == "table").alias("skip")
    )
    log = table(spark, d, "translations").select(
        F.lit("translations").alias("origin"), F.col("record_no").cast("string").alias("record_key"), F.col("translated_text").alias("text"), F.lit(False).alias("skip")
    )
    return markup_residue(segments.unionByName(log), "text", F.col("skip"), with_text)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of markup residue in each record."""
    # explode() would have Spark judge every record once more, for a filter of empty arrays before it
    found = _marked_up(spark, d, False).select("origin", "record_key", F.explode_outer("markup_kinds").alias("markup"))
    return found.where(F.col("markup").isNotNull()).distinct()


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """Each record as clean text."""
    return _marked_up(spark, d, True).select("origin", "record_key", "clean_text")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container, piece and size of every document."""
    sized = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", token_count(F.col("text")).alias("tokens"))
    return pack(sized, F.col("tokens"), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "piece", "start", "size", "container")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return fill_report(p8_containers(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text was cut off."""
    return truncation(table(spark, d, "documents")).where("cut").select("doc_id")


def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut documents per source."""
    return truncation_report(truncation(table(spark, d, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_frequencies, p2_found, p2_content, p3_found, p5_found, p5_text, p6_found, p6_text, p7_ids, p8_containers, p8_fill, p9_found, p9_sources)
}

_blank = "\\s\\x{0085}\\x{00a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_class = lambda chars: "".join(f"\\x{{{ord(c):04x}}}" for c in chars)
_term = (
    f"nfc_normalize(lower(nfc_normalize(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(surface, '[{_class(ZERO_WIDTH)}]', '', 'g'), "
    f"'[{_class(APOSTROPHES)}]', '''', 'g'), '[{_class(DASHES)}]', '-', 'g'), '[{_blank}]+', ' ', 'g')))))"
)
_frequencies = f"""
with once as (select distinct candidate_id, surface, coalesce(occurrences, 0) as occurrences, evidence_segment_ids from term_candidates where surface is not null),
named as (select {_term} as term, occurrences, evidence_segment_ids from once),
totals as (select term, cast(sum(occurrences) as bigint) as occurrences from named group by term),
proved as (select term, count(distinct e) as records from (select term, unnest(evidence_segment_ids) as e from named) group by term),
every as (select count(distinct id) as n from segments)
select t.term, t.occurrences, cast(coalesce(p.records, 0) as bigint) as records,
  case when t.occurrences < 5 then 'rare' when coalesce(p.records, 0) > n / 50.0 then 'common' end as mark
from totals t left join proved p using (term) cross join every
"""
ORACLE: dict[str, str] = {"p1_frequencies": _frequencies, "p1_found": f"select term, mark from ({_frequencies}) where mark is not null"}
