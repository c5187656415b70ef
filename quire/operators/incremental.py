"""Incremental work over an append-only log: compaction, pending work, currency, batches, context."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.runtime import numbered


def latest(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last row of each key by sequence; aggregated before the shuffle, so a hot key costs nothing."""
    rest = [c for c in log.columns if c not in (key, seq)]
    return log.groupBy(key).agg(F.max_by(F.struct(seq, *rest), seq).alias("_r")).select(key, "_r.*")


def current(segments: DataFrame, last: DataFrame) -> DataFrame:
    """segments with their completed row of the same source hash."""
    s = segments.select(F.col("id").alias("segment_id"), "kind", "source_text", F.col("source_hash").alias("_hash"), "book_id", "page_json", "translatable", "parent_node_id")
    done = last.where(F.col("status") == "completed")
    return s.join(done, "segment_id").where(F.col("_hash") == F.col("source_hash")).drop("_hash")


def pending(segments: DataFrame, last: DataFrame) -> DataFrame:
    """Translatable segments without a completed row of their hash."""
    done = last.where(F.col("status") == "completed").select(F.col("segment_id").alias("id"), "source_hash")
    return segments.where("translatable").join(done, ["id", "source_hash"], "left_anti")


def unknown_rows(segments: DataFrame, last: DataFrame) -> DataFrame:
    """Completed rows of segments that are not there."""
    return last.where(F.col("status") == "completed").join(segments.select(F.col("id").alias("segment_id")), "segment_id", "left_anti")


def coverage_class(segments: DataFrame, last: DataFrame) -> DataFrame:
    """id, coverage: missing (no row), stale (status or hash differs) or current."""
    l = last.select(F.col("segment_id").alias("id"), F.col("source_hash").alias("_hash"), "status")
    state = F.when(F.col("status").isNull() & F.col("_hash").isNull(), "missing").when((F.col("status") == "completed") & (F.col("_hash") == F.col("source_hash")), "current").otherwise("stale")
    return segments.select("id", "source_hash").join(l, "id", "left").select("id", state.alias("coverage"))


def coverage(segments: DataFrame, last: DataFrame) -> DataFrame:
    """required, completed, coverage (1 when nothing is required), ready; one row."""
    wanted = segments.where("translatable").select("id", "source_hash")
    done = coverage_class(wanted, last)
    n, c = F.count("*"), F.count_if(F.col("coverage") == "current")
    return done.agg(n.alias("required"), c.alias("completed"), F.round(F.when(n == 0, 1.0).otherwise(c / n), 6).alias("coverage"), (n == c).alias("ready"))


def target_prefix(todo: DataFrame, last: DataFrame, target: int) -> DataFrame:
    """The first rows of pending work by id, as many as the target lacks; a planning limit."""
    done = last.agg(F.count_if(F.col("status") == "completed").alias("_done"))
    placed = numbered(todo.select("id"), "id")
    return placed.crossJoin(F.broadcast(done)).where(F.col("place") <= F.greatest(F.lit(0), F.lit(target) - F.col("_done"))).select("id", F.col("place").cast("int").alias("place"))


def stale_dependencies(rows: DataFrame, versions: DataFrame, hashes: DataFrame, prompt_version: str, mode: str) -> DataFrame:
    """segment_id, is_current: hash, status, mode, prompt version and every recorded dependency must match.

    versions: (book_id, version) as recorded against the current one; a dependency
    without a current version is stale, a new one invalidates nothing.
    """
    met = rows.join(hashes, "segment_id", "left").join(versions.withColumnRenamed("version", "_v"), "book_id", "left")
    ok = (F.col("status") == "completed") & (F.col("source_hash") == F.col("_hash")) & (F.col("prompt_version") == prompt_version) & (F.col("context_mode") == mode)
    return met.select("segment_id", F.coalesce(ok & (F.col("recorded").isNull() | (F.col("recorded") == F.col("_v"))), F.lit(False)).alias("is_current"))


def context_windows(segments: DataFrame, chapter: str, order: list[str], before: int = 2, after: int = 2) -> DataFrame:
    """id, previous, following: texts of neighbours in the chapter, in order."""
    w = Window.partitionBy(chapter).orderBy(*order)
    return segments.select(
        "id",
        F.collect_list("source_text").over(w.rowsBetween(-before, -1)).alias("previous"),
        F.collect_list("source_text").over(w.rowsBetween(1, after)).alias("following"),
    )


def previous_tail(rows: DataFrame, chapter: str, order: list[str], chars: int = 300) -> DataFrame:
    """id, tail: end of the nearest translation before the row, empty if that ends a sentence."""
    w = Window.partitionBy(chapter).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.regexp_replace(F.last("translated_text", ignorenulls=True).over(w), r"[\s\u3000]+$", "")
    return rows.select("id", F.when(last.isNull() | last.rlike("[.!?。！？…][”»“\"’')）]*$"), "").otherwise(F.right(last, F.lit(chars))).alias("tail"))


def plan_batches(pending_rows: DataFrame, most: int = 4, chars: int = 6000, sensitive_most: int = 1) -> DataFrame:
    """id, chapter, batch: consecutive segments of one chapter and one sensitivity, within caps on number and characters.

    pending_rows: id, chapter, position (null: alone), sensitive, size. A batch depends on
    all before it in its chapter, so runs of consecutive positions of one
    sensitivity are cut first; each run is one ordered pass, and chapters run in parallel.
    """
    w = Window.partitionBy("chapter").orderBy("position")
    lone = pending_rows.where("position is null").select("id", "chapter", F.concat(F.lit("alone-"), F.col("id")).alias("batch"))
    runs = pending_rows.where("position is not null").withColumn(
        "_new", F.when((F.col("position") == F.lag("position").over(w) + 1) & (F.col("sensitive") == F.lag("sensitive").over(w)), 0).otherwise(1)
    ).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def cut_run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("position", ignore_index=True)
        out, n, total, start = [], 0, 0, None
        for pos, size, sens in p[["position", "size", "sensitive"]].itertuples(index=False):
            cap = sensitive_most if sens else most
            if n and (n >= cap or total + size > chars):
                n = 0
            if not n:
                start, total = pos, 0
            out.append(f"{p['chapter'].iat[0]}-{start}")
            n, total = n + 1, total + size
            if n >= cap or total >= chars:
                n = 0
        return p[["id", "chapter"]].assign(batch=out)

    cut = runs.groupBy("chapter", "run").applyInPandas(cut_run, "id string, chapter string, batch string")
    return cut.unionByName(lone)


def batch_summary(batches: DataFrame) -> DataFrame:
    """batches, segments, average_batch_size, max_batch_size, singleton_batches; one row."""
    per = batches.groupBy("batch").agg(F.count("*").alias("n"))
    return per.agg(
        F.count("*").alias("batches"), F.coalesce(F.sum("n"), F.lit(0)).alias("segments"), F.coalesce(F.round(F.avg("n"), 4), F.lit(0.0)).alias("average_batch_size"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_batch_size"), F.count_if(F.col("n") == 1).alias("singleton_batches"),
    )


def chunks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with chunk and place: chunks of a fixed size in order."""
    return numbered(rows, *order, name="_r").withColumn("_n", F.col("_r") - 1).drop("_r").withColumns({"chunk": F.floor(F.col("_n") / size).cast("int"), "place": (F.col("_n") % size).cast("int")}).drop("_n")
