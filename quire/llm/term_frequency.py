"""Frequency of every distinct term.

Vertical layout. Each record id gets a dense position; a term's records are a
bitmap over positions, kept as its non-zero 64-bit words (term, word number,
bits), which is the compressed form: empty words take no room. Occurrence
counters run beside the bitmaps in the same aggregation. Bitmaps of different
partitions merge by union (``bit_or``), which Spark does before the shuffle and
after it, and the document frequency is the sum of the words' cardinalities.

A term in a third of all rows has its words spread over all partitions; a
record id in a third of all rows meets a dictionary with one row per id, where
adaptive execution splits the hot side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.text import one_form

#: Record ids in one numbering range of the dictionary, on average.
IDS_PER_RANGE = 16_384


def positions(ids: DataFrame) -> DataFrame:
    """(record_id, known) with repeats to (record_id, known, range_no, place): dense places within ranges.

    The number of ranges follows the number of ids, so a range is sorted in one
    task at any size; ids are distinct, so ranges are even.
    """
    distinct = ids.groupBy("record_id").agg(F.max("known").alias("known"))
    ranges = distinct.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / IDS_PER_RANGE)).alias("ranges"))
    placed = distinct.crossJoin(F.broadcast(ranges)).withColumn("range_no", F.pmod(F.xxhash64("record_id"), F.col("ranges")))
    w = Window.partitionBy("range_no").orderBy("record_id")
    return placed.select("record_id", "known", "range_no", (F.row_number().over(w) - 1).cast("long").alias("place"))


def term_bitmaps(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term, occurrences, record_id) to (term, word_no, bits, occurrences).

    record_id may be null (an occurrence without evidence), which sets no bit.
    """
    at = entries.join(dictionary.select("record_id", "range_no", "place"), "record_id", "left")
    return at.groupBy(
        "term",
        F.when(F.col("place").isNotNull(), F.shiftleft(F.col("range_no"), 32) + F.shiftright(F.col("place"), 6)).alias("word_no"),
    ).agg(
        F.bit_or(F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int")), F.lit(0).cast("long"))).alias("bits"),
        F.sum("occurrences").alias("occurrences"),
    )


def merge_bitmaps(*parts: DataFrame) -> DataFrame:
    """Union of bitmaps built over one dictionary; counters add up."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("term", "word_no").agg(F.bit_or("bits").alias("bits"), F.sum("occurrences").alias("occurrences"))


def frequencies(bitmaps: DataFrame) -> DataFrame:
    """(term, occurrences, records) from bitmaps."""
    return bitmaps.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum(F.bit_count("bits")).cast("long").alias("records"))


def once_each(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Each key once; rows without a key count once for each distinct content."""
    return (
        rows.select(key, *values)
        .withColumn("_c", F.when(F.col(key).isNull(), F.struct(*values)))
        .groupBy(key, "_c")
        .agg(F.max(F.struct(*values)).alias("_v"))
        .select(key, "_v.*")
    )


def term_frequency(
    candidates: DataFrame,
    records: DataFrame,
    term: Column | None = None,
    rare_below: int = 5,
    common_above: float = 1 / 50,
    surface_col: str = "surface",
    occurrences_col: str = "occurrences",
    evidence_col: str = "evidence_segment_ids",
    key_col: str = "candidate_id",
    record_col: str = "id",
) -> DataFrame:
    """term, occurrences, records, mark for every distinct term.

    Repeated rows of a candidate count once (of differing rows under one key
    the greatest counts); a null surface has no term and is left out; null
    occurrences count as none, null or empty evidence and null ids in it prove
    nothing, ids that are no known record count all the same. mark is ``rare``
    below rare_below occurrences, else ``common`` above that share of the distinct
    records, else null. Without records nothing but evidence can be common.
    """
    once = once_each(candidates.where(F.col(surface_col).isNotNull()), key_col, surface_col, occurrences_col, evidence_col)
    named = once.select(
        one_form(F.col(surface_col)).alias("term") if term is None else term.alias("term"),
        F.coalesce(F.col(occurrences_col).cast("long"), F.lit(0)).alias("occurrences"),
        F.array_distinct(F.col(evidence_col)).alias("evidence"),
    )
    entries = named.select("term", F.col("occurrences").alias("_n"), F.posexplode_outer("evidence").alias("_at", "record_id")).select(
        "term", F.when(F.coalesce(F.col("_at"), F.lit(0)) == 0, F.col("_n")).otherwise(0).alias("occurrences"), "record_id"
    )
    ids = (
        records.where(F.col(record_col).isNotNull())
        .select(F.col(record_col).alias("record_id"), F.lit(1).alias("known"))
        .unionByName(
            candidates.select(F.explode(evidence_col).alias("record_id"), F.lit(0).alias("known")).where(F.col("record_id").isNotNull())
        )
    )
    dictionary = positions(ids)
    total = records.agg(F.count_distinct(F.col(record_col)).alias("total"))
    counted = frequencies(term_bitmaps(entries, dictionary)).crossJoin(F.broadcast(total))
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > F.col("total") * F.lit(common_above), "common")
    return counted.select("term", "occurrences", "records", mark.alias("mark"))
