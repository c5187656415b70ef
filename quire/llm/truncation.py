"""Texts cut off by field limits or in mid-transfer.

Per source, histograms of text lengths in characters and in bytes are tested for
spikes: lengths far more frequent than their neighbourhood. A text at a spike without
terminal punctuation was cut by a limit; an ellipsis, which may be the author's, counts
there as the mark of the cut. A text that ends open or with a cut mark at no
spike broke off in transfer; the two are told apart as causes.

A text may end without terminal punctuation and yet be complete: with a list
item, table row, signature, address or closing remark. Closing remarks are learned: a
last line that closes several different texts of the corpus is one, for a text cut
anywhere ends as no other does. Common ones are known beforehand. The other forms are
tested on the last line.

Everything runs inside the JVM. The histograms are aggregated per (source,
length), so a source that holds a third of all rows leaves at most as many rows
as it has different lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks left at a cut, common closing remarks of complete texts.
CUT_MARKS = ["[more]", "[…]", "[...]", "�"]
CLOSINGS = (
    "the end|end|finis|fin|fin du texte|ende|ende des textes|end of (?:the )?(?:excerpt|extract|document|text|chapter)|"
    "节选完|完|全文完|（完）|待续|to be continued|fortsetzung folgt|à suivre|yours (?:sincerely|faithfully|truly),?|(?:best|kind) regards,?|"
    "mit freundlichen grüßen,?|hochachtungsvoll,?|cordialement,?|此致敬礼|此致|敬礼"
)
#: Different texts that a line must close to be a closing remark.
CLOSES_TEXTS = 3
BLANK = " \t\r\n\u000b\f\u0085   　​﻿"
#: Neighbouring lengths on either side against which a length is compared.
NEIGHBOURHOOD = 40


def _last_line(text: Column) -> tuple[Column, Column]:
    """The text without outer blanks and note marks at its end, and the last line of it."""
    bare = F.rtrim(text, F.lit(BLANK))
    noted = F.when(bare.endswith("]"), F.rtrim(F.regexp_replace(bare, r"(?:\s*\[\^[^\]\s]+\])+$", ""), F.lit(BLANK))).otherwise(bare)
    return bare, F.trim(F.substring_index(noted, "\n", -1))


def ending(text: Column) -> Column:
    """How a text ends: blank, marked (a cut mark), ellipsis, terminal, list, table, signature, address, closing or open; null for null."""
    bare, line = _last_line(text)
    marked = F.lit(False)
    for m in CUT_MARKS:
        marked = marked | bare.endswith(m)
    unclosed = line.rlike(r"[(（][^()（）]*$")
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(bare == "", "blank")
        .when(marked, "marked")
        .when(line.rlike(r"(?:…|\.\.\.)[”»“\"’')）\]]*$"), "ellipsis")
        .when(line.rlike(r"[.!?。！？।؟][”»“\"’'」』)）】\]*_`]*$|[”»“\"’'」』]\s?[.!?]$|[   ][!?»]$") & ~line.rlike(r"[,，][”»“]$") & ~unclosed, F.when(line.rlike(r"[^.!?。！？…   ]\s?»$"), "open").otherwise("terminal"))
        .when(line.rlike(r"^(?:[-*•+]|\d{1,3}[.)])\s+\S"), "list")
        .when(line.startswith("|") & line.endswith("|"), "table")
        .when(line.rlike(r"^[—–―-]{1,3} ?\S"), "signature")
        .when(line.rlike(r"(?:https?://|www\.)\S+$|\S+@\S+\.\w+$|^\d{1,5} (?:\p{Lu}\w+ )+(?:Street|Lane|Road|Avenue|Square)$|^\d{4,5} \p{Lu}\w+$"), "address")
        .when(F.lower(line).rlike(f"^(?:{CLOSINGS})$"), "closing")
        .otherwise("open")
    )


def length_spikes(documents: DataFrame, text_col: str = "text", source_col: str = "source", least: int = 5) -> DataFrame:
    """source, measure (chars or bytes), length, texts: lengths that stand out of their neighbourhood.

    A length is a spike if at least ``least`` texts have it and they exceed three
    times the mean of the neighbourhood as well as that mean by six of its
    standard deviations. The bytes of a replacement character at the end, left by
    a character cut in two, are not counted.
    """
    text = F.col(text_col)
    whole = F.when(text.endswith("�"), F.expr(f"left(`{text_col}`, length(`{text_col}`) - 1)")).otherwise(text)
    counts = (
        documents.where(text.isNotNull())
        .select(
            F.col(source_col).alias("source"),
            F.explode(F.create_map(F.lit("chars"), F.length(text), F.lit("bytes"), F.octet_length(whole))).alias("measure", "length"),
        )
        .groupBy("source", "measure", "length")
        .agg(F.count("*").alias("texts"))
    )
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-NEIGHBOURHOOD, NEIGHBOURHOOD)
    mean = (F.sum("texts").over(near) - F.col("texts")) / (2 * NEIGHBOURHOOD)
    return counts.withColumn("_mean", mean).where(
        (F.col("texts") >= least) & (F.col("texts") > 3 * F.col("_mean")) & (F.col("texts") > F.col("_mean") + 6 * F.sqrt("_mean"))
    ).select("source", "measure", "length", "texts")


def closing_lines(rows: DataFrame) -> DataFrame:
    """(_line): hashes of the last lines that close several different texts; rows: text, ending, _line.

    A line that is the whole text closes nothing. Texts are compared by hash, so copies count once.
    """
    last = rows.where((F.col("ending") == "open") & F.col("_several")).select("_line", F.xxhash64("text").alias("_text")).distinct()
    return last.groupBy("_line").agg(F.count("*").alias("_texts")).where(F.col("_texts") >= CLOSES_TEXTS).select("_line")


def truncation(documents: DataFrame, key: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """key, source, ending, at_limit, cut, cause for every row.

    at_limit says whether the length is a spike of the source. cut is true for texts that
    end open or with a cut mark, and for texts that end with an ellipsis at a spike; their
    cause is ``limit`` at a spike, else ``transfer``. Null and blank texts are not cut.
    Rows without a source form one source. Repeated rows stay; other columns are not
    looked at.
    """
    rows = documents.select(F.col(key), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    spikes = length_spikes(rows)
    whole = F.when(F.col("text").endswith("\ufffd"), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    bare, line = _last_line(F.col("text"))
    # copies have one hash, so the text itself is not carried along
    judged = rows.select(
        key, "source", ending(F.col("text")).alias("ending"), F.length("text").alias("_chars"), F.octet_length(whole).alias("_bytes"),
        F.xxhash64(F.lower(line)).alias("_line"), (line != bare).alias("_several"), F.xxhash64("text").alias("text"),
    )
    closings = closing_lines(judged).select(F.col("_line").alias("_closing"))
    # only open endings look for their line
    wanted = F.when(F.col("ending") == "open", F.col("_line"))
    measured = judged.join(closings, wanted == F.col("_closing"), "left").withColumn("ending", F.when(F.col("_closing").isNotNull(), "closing").otherwise(F.col("ending")))
    limits = spikes.groupBy("source").agg(
        F.collect_list(F.when(F.col("measure") == "chars", F.col("length"))).alias("_char_limits"),
        F.collect_list(F.when(F.col("measure") == "bytes", F.col("length"))).alias("_byte_limits"),
    )
    met = measured.join(limits.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    at_limit = F.coalesce(
        F.array_contains("_char_limits", F.col("_chars")) | F.array_contains("_byte_limits", F.col("_bytes")), F.lit(False)
    )
    cut = F.coalesce(F.col("ending").isin("open", "marked") | ((F.col("ending") == "ellipsis") & at_limit), F.lit(False))
    cause = F.when(cut, F.when(at_limit, "limit").otherwise("transfer"))
    return met.select(key, "source", "ending", at_limit.alias("at_limit"), cut.alias("cut"), cause.alias("cause"))


def truncation_report(judged: DataFrame) -> DataFrame:
    """source, documents, cut, cut_share, cut_at_limit, cut_in_transfer from truncation()."""
    return judged.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if("cut").alias("cut"),
        F.round(F.count_if("cut") / F.count("*"), 6).alias("cut_share"),
        F.count_if(F.col("cause") == "limit").alias("cut_at_limit"),
        F.count_if(F.col("cause") == "transfer").alias("cut_in_transfer"),
    )
