"""Chapters of a heading tree: which one a segment belongs to, what each holds, and matching against the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.hierarchy import hierarchy, paths
from quire.runtime import cut


def chapter_ancestors(nodes: DataFrame) -> DataFrame:
    """node_id, chapter_id, anchor_id: the nearest node of kind chapter from each node upwards, and the child of the root above it.

    nodes: id, parent_id, kind. On and below a cycle the way up ends at the first node on
    it. A root has no anchor; a node without a chapter above it has none.
    """
    trail = cut(paths(hierarchy(nodes)))
    up = trail.select("node_id", F.posexplode("path").alias("_at", "_above"))
    kinds = nodes.where("kind = 'chapter'").select(F.col("id").alias("_above")).distinct()
    nearest = up.join(kinds, "_above").groupBy("node_id").agg(F.max_by("_above", "_at").alias("chapter_id"))
    return trail.select("node_id", F.get("path", F.lit(1)).alias("anchor_id")).join(nearest, "node_id", "left").select("node_id", "chapter_id", "anchor_id")


def chapter_keys(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """segments with chapter_id: the nearest chapter above, else the heading's own chapter node, else null.

    segments: parent_node_id, metadata (struct of node_id, node_kind).
    """
    above = chapter_ancestors(nodes).select(F.col("node_id").alias("parent_node_id"), F.col("chapter_id").alias("_above"))
    own = nodes.where("kind = 'chapter'").select(F.col("id").alias("_own")).distinct()
    heading = F.when(F.col("metadata.node_kind") == "chapter", F.col("metadata.node_id"))
    met = segments.join(above, "parent_node_id", "left").withColumn("_heading", heading).join(own, F.col("_heading") == F.col("_own"), "left")
    return met.withColumn("chapter_id", F.coalesce("_above", "_own")).drop("_above", "_own", "_heading")


def chapter_briefs(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """chapter_id, title, kind, first_page, last_page, section_titles, segments, translatable, brief_hash.

    One row per chapter node, with the titles of the sections below it in order of page and
    id, and one per zone for translatable segments without a chapter. Pages are 0 where none is known.
    """
    keyed = chapter_keys(segments, nodes).withColumn("translatable", F.coalesce("translatable", F.lit(False)))
    zone = F.when(F.col("translatable"), F.concat(F.lit("zone:"), F.coalesce("zone", F.lit(""))))
    sums = keyed.withColumn("_key", F.coalesce("chapter_id", zone)).where("_key is not null").groupBy("_key").agg(
        F.min("page_json").alias("_a"), F.max("page_json").alias("_b"), F.count("*").alias("_n"), F.count_if("translatable").alias("_t")
    )
    chapters = nodes.where("kind = 'chapter'").groupBy(F.col("id").alias("_id")).agg(F.min("title_source").alias("_title"))
    below = paths(hierarchy(nodes)).select("node_id", F.explode("path").alias("_id")).where("node_id <> _id").join(chapters.select("_id"), "_id")
    sections = nodes.where("kind = 'section'").groupBy(F.col("id").alias("node_id")).agg(F.min("title_source").alias("_s"), F.min("page_json").alias("_p"))
    titles = below.join(sections, "node_id").groupBy("_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.coalesce("_p", F.lit(-1)).alias("p"), "node_id", F.coalesce("_s", F.lit("")).alias("s")))), lambda x: x["s"]).alias("_titles")
    )
    every = chapters.join(titles, "_id", "left").join(sums, F.col("_id") == F.col("_key"), "full_outer")
    out = every.select(
        F.coalesce("_id", "_key").alias("chapter_id"),
        F.coalesce("_title", F.lit("")).alias("title"),
        F.when(F.col("_id").isNotNull(), "chapter").otherwise("zone_bucket").alias("kind"),
        F.coalesce("_a", F.lit(0)).alias("first_page"),
        F.coalesce("_b", F.lit(0)).alias("last_page"),
        F.coalesce("_titles", F.array().cast("array<string>")).alias("section_titles"),
        F.coalesce("_n", F.lit(0)).alias("segments"),
        F.coalesce("_t", F.lit(0)).alias("translatable"),
    )
    return out.withColumn("brief_hash", tx.digest(*(F.to_json(F.struct(c)) for c in out.columns)))


def first_match(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """candidate_id, node_id, rule: the node each candidate stands for.

    candidates: candidate_id, book_id, page, title, token; nodes: node_id, book_id, page, title,
    ordinal, block_id. Rules in order: the node's block is the candidate; same page and
    title; same page and number. Within a rule the smallest node id counts. Each rule is a join on its keys.
    """
    c = candidates.select(*(F.col(x).alias(f"c_{x}") for x in ("candidate_id", "book_id", "page", "title", "token")))
    book = F.col("c_book_id") == F.col("book_id")
    page = book & (F.col("c_page") == F.col("page"))
    rules = (book & (F.col("c_candidate_id") == F.col("block_id")), page & (F.col("c_title") == F.col("title")) & (F.col("title") != ""), page & (F.col("c_token") == F.col("ordinal")))
    met = None
    for k, on in enumerate(rules, 1):
        one = c.join(nodes, on).groupBy(F.col("c_candidate_id").alias("candidate_id")).agg(F.min("node_id").alias("node_id")).withColumn("rule", F.lit(k))
        met = one if met is None else met.unionByName(one)
    return met.groupBy("candidate_id").agg(F.min_by("node_id", "rule").alias("node_id"), F.min("rule").alias("rule"))


def identity_match(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, rule: by block, else by a title that both sides have once in their book, else by title and page.

    left, right: id, book_id, block_id, title, page. Of several rows the smallest id counts.
    """

    def alone(df: DataFrame) -> DataFrame:
        return df.where("title is not null and title <> ''").groupBy("book_id", "title").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")

    def pairs(a: DataFrame, b: DataFrame, keys: list[str], rule: int) -> DataFrame:
        r = b.select(*keys, F.col("id").alias("right_id"))
        return a.select(*keys, F.col("id").alias("left_id")).join(r, keys).groupBy("left_id").agg(F.min("right_id").alias("right_id")).withColumn("rule", F.lit(rule))

    met = pairs(left, right, ["book_id", "block_id"], 1).unionByName(pairs(alone(left), alone(right), ["book_id", "title"], 2)).unionByName(pairs(left, right, ["book_id", "title", "page"], 3))
    return met.groupBy("left_id").agg(F.min_by("right_id", "rule").alias("right_id"), F.min("rule").alias("rule"))


def document_order(nodes: DataFrame) -> DataFrame:
    """id, place: nodes of a book by page (unknown first), level (unknown first) and id."""
    w = Window.partitionBy("book_id").orderBy(F.asc_nulls_first("page_json"), F.asc_nulls_first("level"), "id")
    return nodes.select("id", F.row_number().over(w).alias("place"))


def style_clusters(rows: DataFrame, samples: int = 8) -> DataFrame:
    """level, rows, sample_ids: how many rows a level has, and the smallest ids as samples (a report's limit)."""
    w = Window.partitionBy("level").orderBy("id")
    few = rows.withColumn("_n", F.row_number().over(w))
    return few.groupBy("level").agg(F.count("*").alias("rows"), F.sort_array(F.collect_list(F.when(F.col("_n") <= samples, F.col("id")))).alias("sample_ids"))


def joined_footnotes(notes: DataFrame, starts: Column) -> DataFrame:
    """page keys, note_no, first_id, text: a footnote block that does not start a note goes on with the one before it on its page.

    notes: id, book_id, page_index, block_index, content. A page may open with a continuation: note 0.
    """
    w = Window.partitionBy("book_id", "page_index").orderBy("block_index", "id")
    told = notes.withColumn("note_no", F.sum(F.coalesce(starts, F.lit(False)).cast("int")).over(w).cast("int"))
    part = F.struct("block_index", "id", F.coalesce("content", F.lit("")).alias("content"))
    return told.groupBy("book_id", "page_index", "note_no").agg(F.sort_array(F.collect_list(part)).alias("_parts")).select(
        "book_id", "page_index", "note_no", F.col("_parts")[0]["id"].alias("first_id"), F.array_join(F.transform("_parts", lambda x: x["content"]), " ").alias("text")
    )
