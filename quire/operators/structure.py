"""Structure of scanned books: page numbers, running heads, zones, candidates, styles, stitching, heading trees.

Blocks are rows of id, book_id, page_index, block_index, label, content, bbox,
block_order, page_width, page_height; nodes are rows of a heading tree. Every
window is per book and page or per book and title; whole-book statistics are
aggregated first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as geo
from quire.functions import text as tx

MACRO = ["doc_title", "paragraph_title", "header", "vision_heading", "vision_heading_unmatched"]


def flatten_pages(pages: DataFrame) -> DataFrame:
    """Blocks of OCR pages: page_index, block_index, raw_block_id, label, content, bbox, block_order, page_width, page_height, sort_pos.

    pages: page_index and prunedResult.parsing_res_list. A missing list has no
    blocks, a bad box is zeros, an order that is no integer is null. One canvas
    for all pages (largest x2 and y2, at least 1) sizes them.
    """
    raw = pages.select("page_index", F.posexplode("prunedResult.parsing_res_list").alias("block_index", "b"))
    box = F.when(F.size("b.block_bbox") == 4, F.col("b.block_bbox")).otherwise(F.array(*[F.lit(0.0)] * 4))
    rows = raw.select(
        "page_index", "block_index", F.col("b.block_id").cast("string").alias("raw_block_id"), F.coalesce("b.block_label", F.lit("")).alias("label"),
        F.coalesce("b.block_content", F.lit("")).alias("content"), box.alias("bbox"), F.col("b.block_order").try_cast("int").alias("block_order"),
    )
    canvas = rows.agg(F.greatest(F.max(F.element_at("bbox", 3)), F.lit(1.0)).alias("page_width"), F.greatest(F.max(F.element_at("bbox", 4)), F.lit(1.0)).alias("page_height"))
    w = Window.partitionBy("page_index").orderBy(F.col("block_order").isNull(), F.coalesce(F.col("block_order").cast("double"), F.element_at("bbox", 2)), F.element_at("bbox", 1), "block_index")
    return rows.crossJoin(F.broadcast(canvas)).withColumn("sort_pos", F.row_number().over(w))


def block_ids(blocks: DataFrame) -> DataFrame:
    """id, block_key: content-addressed id of each block; a missing raw id prints as None."""
    return blocks.select("id", tx.stable_id("blk-", F.col("page_index"), F.col("raw_block_id"), F.col("block_index"), F.coalesce("label", F.lit("")), F.coalesce("content", F.lit(""))).alias("block_key"))


def page_offsets(blocks: DataFrame) -> DataFrame:
    """book_id, page_offset, support, observations, confidence: the usual printed number less page index.

    Ties go to the offset seen first in page order.
    """
    y = F.element_at(geo.normalized(F.col("bbox"), F.col("page_width"), F.col("page_height")), 2)
    printed = F.regexp_extract("content", r"(\d+)", 1).try_cast("int")
    seen = blocks.where((F.col("label") == "number") & printed.isNotNull() & ((y <= 0.12) | (y >= 0.85))).select("book_id", (printed - F.col("page_index")).alias("page_offset"), "page_index")
    per = seen.groupBy("book_id", "page_offset").agg(F.count("*").alias("support"), F.min("page_index").alias("_first"))
    best = per.groupBy("book_id").agg(F.max(F.struct("support", (-F.col("_first")).alias("f"), (-F.col("page_offset")).alias("o"))).alias("m"), F.sum("support").alias("observations"))
    return best.select("book_id", (-F.col("m.o")).alias("page_offset"), F.col("m.support").alias("support"), "observations", F.round(F.col("m.support") / F.col("observations"), 6).alias("confidence"))


def running_heads(blocks: DataFrame, least: int = 5, spread: float = 0.8) -> DataFrame:
    """book_id, title, printings, first_page, last_page of header titles that run through a book."""
    heads = blocks.where(F.col("label") == "header").select("book_id", F.lower(tx.canonical_heading(F.col("content"))).alias("title"), "page_index").where("title <> ''")
    size = blocks.groupBy("book_id").agg((F.max("page_index") - F.min("page_index")).alias("_span"))
    per = heads.groupBy("book_id", "title").agg(F.count("*").alias("printings"), F.min("page_index").alias("first_page"), F.max("page_index").alias("last_page"))
    return per.where(F.col("printings") >= least).join(size, "book_id").where(F.col("last_page") - F.col("first_page") >= spread * F.col("_span")).drop("_span")


def repeated_headers(blocks: DataFrame, least: int = 5) -> DataFrame:
    """book_id, title, printings, first_page of header titles printed at least so often."""
    heads = blocks.where(F.col("label") == "header").select("book_id", F.lower(tx.canonical_heading(F.col("content"))).alias("title"), "page_index").where("title <> ''")
    return heads.groupBy("book_id", "title").agg(F.count("*").alias("printings"), F.min("page_index").alias("first_page")).where(F.col("printings") >= least)


def page_zones(blocks: DataFrame, main_start: int = 0, share: float = 0.55) -> DataFrame:
    """book_id, page_index, zone: a heading of notes, bibliography or index far enough in the book opens its zone until the next."""
    per = blocks.groupBy("book_id").agg((F.max("page_index") + 1).alias("pages"))
    found = (
        blocks.where(F.col("label").isin("doc_title", "paragraph_title", "header"))
        .select("book_id", "page_index", F.coalesce("block_order", "block_index").alias("o"), tx.zone_of_heading(F.col("content")).alias("zone"))
        .where("zone is not null")
        .join(per, "book_id")
        .where(F.col("page_index") >= F.greatest(F.lit(main_start + 5), F.floor(F.col("pages") * share)))
        .groupBy("book_id", "page_index")
        .agg(F.min_by("zone", "o").alias("opened"))
    )
    w = Window.partitionBy("book_id").orderBy("page_index").rowsBetween(Window.unboundedPreceding, 0)
    pages = blocks.select("book_id", "page_index").distinct().join(found, ["book_id", "page_index"], "left")
    return pages.select("book_id", "page_index", F.when(F.col("page_index") < main_start, "frontmatter").otherwise(F.coalesce(F.last("opened", True).over(w), F.lit("mainmatter"))).alias("zone"))


def toc_pages(blocks: DataFrame, first: int = 0, last: int = 30) -> DataFrame:
    """book_id, page_index of pages that carry a table of contents, by title or layout label."""
    title = F.lower(tx.canonical_heading(F.col("content"))).rlike(r"^(?:table of contents|contents|inhalt|inhaltsverzeichnis|table des matières|目录)$")
    return blocks.where(F.col("page_index").between(first, last) & (title | F.col("label").isin("toc", "content", "catalogue"))).select("book_id", "page_index").distinct()


def alignment_candidates(blocks: DataFrame, toc: DataFrame) -> DataFrame:
    """id, book_id, page_index, title of blocks that may be headings: macro labels, or short text without an end, off the contents pages."""
    text = tx.clean_content(F.col("content"))
    box = geo.normalized(F.col("bbox"), F.col("page_width"), F.col("page_height"))
    short = (
        (F.col("label") == "text") & F.length(text).between(1, 180) & (tx.word_count(text) <= 24) & ~text.rlike("[.?!;。？！；]$")
        & (F.element_at(box, 2) >= 0.08) & (F.element_at(box, 4) <= 0.92)
    )
    ok = (F.col("label").isin(MACRO) | short) & tx.rejection_reason(F.col("content")).isNull()
    return blocks.where(ok).join(toc, ["book_id", "page_index"], "left_anti").select("id", "book_id", "page_index", tx.canonical_heading(F.col("content")).alias("title"))


def text_candidates(blocks: DataFrame) -> DataFrame:
    """id, whitespace, confidence, suppressed of short text blocks that stand free enough to be headings."""
    box = geo.normalized(F.col("bbox"), F.col("page_width"), F.col("page_height"))
    w = Window.partitionBy("book_id", "page_index").orderBy("y1", "block_index")
    rows = blocks.where("bbox is not null").withColumns({"y1": F.element_at(box, 2), "y2": F.element_at(box, 4), "wide": F.element_at(box, 3) - F.element_at(box, 1)})
    above, below = F.col("y1") - F.coalesce(F.lag("y2").over(w), F.lit(0.0)), F.coalesce(F.lead("y1").over(w), F.lit(1.0)) - F.col("y2")
    rows = rows.withColumn("whitespace", F.least(F.lit(1.0), (F.greatest(above, F.lit(0.0)) + F.greatest(below, F.lit(0.0))) / 0.06))
    text = tx.clean_content(F.col("content"))
    keep = (F.col("label") == "text") & F.length(text).between(2, 100) & (tx.word_count(text) <= 14) & (F.col("y2") - F.col("y1") <= 0.065) & (F.col("wide") <= 0.82) & (F.col("whitespace") >= 0.35)
    return rows.where(keep).select("id", F.round("whitespace", 6).alias("whitespace"), F.round(0.45 + 0.25 * F.col("whitespace"), 6).alias("confidence"), tx.rejection_reason(F.col("content")).alias("suppressed"))


def visual_context(blocks: DataFrame) -> DataFrame:
    """id, inside, beside: whether a heading block lies in a picture or table, or next to one under a caption prefix."""
    box = geo.normalized(F.col("bbox"), F.col("page_width"), F.col("page_height"))
    rows = blocks.where("bbox is not null").select("id", "book_id", "page_index", "label", "content", box.alias("box"))
    heads = rows.where(F.col("label").isin("doc_title", "paragraph_title", "figure_title"))
    frames = rows.where(F.col("label").isin("image", "table", "chart")).select("book_id", "page_index", F.col("box").alias("frame"))
    inside = (geo.intersection_ratio(F.col("box"), F.col("frame")) >= 0.8) & (geo.area(F.col("frame")) >= 0.08)
    caption = F.lower("content").rlike(r"^\W*(?:fig|figure|abb|abbildung|table|tab|map|karte|plate)\b")
    beside = (geo.horizontal_overlap(F.col("box"), F.col("frame")) >= 0.35) & (geo.vertical_gap(F.col("box"), F.col("frame")) <= 0.035) & caption
    met = heads.join(frames, ["book_id", "page_index"], "left")
    return met.groupBy("id").agg(F.coalesce(F.bool_or(inside), F.lit(False)).alias("inside"), F.coalesce(F.bool_or(beside), F.lit(False)).alias("beside"))


def merge_candidates(blocks: DataFrame) -> DataFrame:
    """Heading blocks of one page and title as one candidate: ids, labels, union of boxes, strongest label."""
    rank = F.when(F.col("label") == "doc_title", 0).when(F.col("label") == "paragraph_title", 1).when(F.col("label") == "header", 2).otherwise(3)
    title = F.lower(tx.canonical_heading(F.col("content")))
    x1, y1, x2, y2 = geo.sides(F.col("bbox"))
    return (
        blocks.where(F.col("label").isin("doc_title", "paragraph_title", "header") & (title != ""))
        .groupBy("book_id", "page_index", title.alias("title"))
        .agg(
            F.array_sort(F.collect_set("id")).alias("block_ids"), F.array_sort(F.collect_set("label")).alias("labels"), F.min_by("label", F.struct(rank, "block_index", "id")).alias("strongest"),
            F.min(x1).alias("x1"), F.min(y1).alias("y1"), F.max(x2).alias("x2"), F.max(y2).alias("y2"),
        )
    )


def repetition(candidates: DataFrame, reach: int = 10) -> DataFrame:
    """book_id, page_index, title, printings, nearby: how often a title stands in the book and within ten pages."""
    key = Window.partitionBy("book_id", "title")
    near = key.orderBy("page_index").rangeBetween(-reach, reach)
    return candidates.select("book_id", "page_index", "title", F.count("*").over(key).alias("printings"), F.when(F.col("page_index").isNull(), 0).otherwise(F.count("*").over(near)).alias("nearby"))


def numbering_summary(titles: DataFrame, title: str) -> DataFrame:
    """family, titles, tokens: numbering families with up to five sample tokens."""
    n = tx.numbering(F.col(title))
    return titles.where(n.isNotNull()).groupBy(n["family"].alias("family")).agg(F.count("*").alias("titles"), F.slice(F.array_sort(F.collect_set(n["token"])), 1, 5).alias("tokens"))


def block_context(blocks: DataFrame, chars: int = 80) -> DataFrame:
    """id, before, after: starts of the neighbouring blocks on the page."""
    w = Window.partitionBy("book_id", "page_index").orderBy("block_index", "id")
    return blocks.select("id", F.left(F.lag("content").over(w), F.lit(chars)).alias("before"), F.left(F.lead("content").over(w), F.lit(chars)).alias("after"))


def stitch(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs run on over a page break: first_id, ids, text, pages.

    paragraphs: id, parent, zone, page, ordinal, text. A paragraph joins the one
    before it in its parent and zone if it is on the next page and that one ends
    no sentence; a hyphen at the joint goes.
    """
    w = Window.partitionBy("parent", "zone").orderBy("page", "ordinal", "id")
    runs_on = (F.col("page") == F.lag("page").over(w) + 1) & ~F.lag("text").over(w).rlike("[.!?。！？…:：][”»“\"’')）\\]]*\\s*$")
    grouped = paragraphs.withColumn("_new", F.when(runs_on, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("page", "ordinal", "id", "text")))
    joined = F.aggregate(
        F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))),
        F.element_at("parts", 1)["text"],
        lambda s, p: F.when(s.rlike("[\\p{L}]-\\s*$"), F.concat(F.regexp_replace(s, "-\\s*$", ""), p["text"])).otherwise(F.concat_ws(" ", F.rtrim(s), p["text"])),
    )
    return grouped.groupBy("parent", "zone", "run").agg(parts.alias("parts")).select(
        F.element_at("parts", 1)["id"].alias("first_id"), F.transform("parts", lambda p: p["id"]).alias("ids"), joined.alias("text"), F.size("parts").alias("pieces")
    )


def stack_parents(headings: DataFrame) -> DataFrame:
    """id, parent: the nearest heading before it in the book with a smaller level. headings: id, book_id, seq, level 1 to 6."""
    w = Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.struct("seq", "id")), True).over(w).alias(f"_{k}") for k in range(1, 6)]
    best = F.array_max(F.array_compact(F.array(*[F.when(F.col("level") > k, F.col(f"_{k}")) for k in range(1, 6)])))
    return headings.select("id", "level", *last).select("id", best["id"].alias("parent"))


def keep_first(nodes: DataFrame) -> DataFrame:
    """id, survivor: of nodes with one title, page and zone in a book the first survives; children go to it."""
    title = tx.normalized_title(F.col("title_source"))
    w = Window.partitionBy("book_id", title, "page_json", "zone").orderBy("id")
    return nodes.select("id", F.when(F.coalesce(title, F.lit("")) == "", F.col("id")).otherwise(F.first("id").over(w)).alias("survivor"))


def redirect(nodes: DataFrame, survivors: DataFrame) -> DataFrame:
    """id, parent_id of the surviving nodes, parents that went replaced by who survived them."""
    kept = nodes.join(survivors.where("id = survivor").select("id"), "id", "left_semi")
    to = survivors.select(F.col("id").alias("parent_id"), "survivor")
    return kept.join(to, "parent_id", "left").select("id", F.coalesce("survivor", "parent_id").alias("parent_id"))


def apparatus_duplicates(nodes: DataFrame) -> DataFrame:
    """id of titles in notes, bibliography and index that stand in the main matter of the book too."""
    words = F.trim(F.regexp_replace(F.lower("title_source"), r"[^\p{L}\p{N}_]+", " "))
    n = nodes.where("title_source is not null").select("id", "book_id", "zone", "kind", words.alias("t"))
    main = n.where((F.col("zone") == "mainmatter") & F.col("kind").isin("part", "chapter", "section")).select("book_id", "t")
    return n.where(F.col("zone").isin("notes", "bibliography", "index")).join(main, ["book_id", "t"], "left_semi").select("id")


def styles(blocks: DataFrame) -> DataFrame:
    """id, level, confidence of heading blocks by numbering, else by height against the book's median."""
    x1, y1, x2, y2 = geo.sides(geo.normalized(F.col("bbox"), F.col("page_width"), F.col("page_height")))
    heads = blocks.where(F.col("label").isin("doc_title", "paragraph_title")).select("id", "book_id", F.greatest(F.lit(0.0001), y2 - y1).alias("h"), tx.numbering(tx.clean_content(F.col("content"))).alias("n"))
    typical = heads.groupBy("book_id").agg(F.expr("percentile(h, 0.5)").alias("_m"))
    met = heads.join(typical, "book_id").withColumn("_s", F.col("h") < 0.78 * F.col("_m"))
    small = F.col("_s") & (F.count_if("_s").over(Window.partitionBy("book_id")) >= 2)
    f = F.col("n.family")

    def by(plain: Column, *of: Column) -> Column:
        return (
            F.when(f == "decimal", of[0]).when(f == "upper_letter", of[1]).when(f == "lower_letter", of[2]).when(f == "section_symbol", of[3])
            .when(f.isin("teil", "part", "book", "volume"), of[4]).when(f.isin("kapitel", "chapter"), of[5]).otherwise(plain)
        )

    level = by(F.when(small, 4).otherwise(3), F.least(F.lit(6), 2 + F.col("n.depth")), *map(F.lit, (3, 4, 5, 2, 3)))
    confidence = by(F.when(small & F.col("n").isNull(), 0.88).otherwise(0.93), *map(F.lit, (0.98, 0.96, 0.94, 0.99, 0.97, 0.97)))
    return met.select("id", level.cast("int").alias("level"), confidence.alias("confidence"))


def check_nodes(nodes: DataFrame) -> DataFrame:
    """code, node_id of broken constraints of a heading tree.

    nodes: id, book_id, kind, level, title_source, page_json, parent_id, block_id, zone, evidence; one row per id.
    """
    p = nodes.select(F.col("id").alias("_p"), F.col("level").alias("_level"), F.col("page_json").alias("_page"))
    met = nodes.withColumn("parent", F.nullif(F.lower(F.trim("parent_id")), F.lit(""))).join(p, F.col("parent") == F.col("_p"), "left")
    title = tx.normalized_title(F.col("title_source"))
    same = Window.partitionBy("book_id", title, "page_json")
    block = Window.partitionBy("block_id")
    rows = met.withColumns({"_same": F.count("*").over(same), "_block": F.count("*").over(block)})
    codes = {
        "missing_parent": F.col("parent").isNotNull() & F.col("_p").isNull(),
        "missing_provenance": F.col("block_id").isNull() & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0),
        "suspicious_heading_text": tx.rejection_reason(F.col("title_source")).isNotNull(),
        "main_heading_in_apparatus": F.col("kind").isin("part", "chapter") & F.col("zone").isin("notes", "bibliography", "index"),
        "heading_level_out_of_range": ~F.col("level").between(1, 6),
        "hierarchy_parent_not_shallower": F.col("_level") >= F.col("level"),
        "level_jump": F.col("level") > F.col("_level") + 1,
        "parent_after_child": F.col("_page") > F.col("page_json"),
        "duplicate_block_occupation": F.col("block_id").isNotNull() & (F.col("_block") > 1),
        "duplicate_heading": (title != "") & (F.col("_same") > 1),
        "orphan_section": F.col("parent").isNull() & (F.col("level") >= 3),
    }
    return rows.select(F.col("id").alias("node_id"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in codes.items()]))).alias("code"))


def tree_diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """key, change between two trees: added, removed, level, kind, parent; ambiguous keys are left out."""
    def one(t: DataFrame, p: str) -> DataFrame:
        return t.groupBy(*key).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"{p}{c}") for c in ("level", "kind", "parent")]).where("_n = 1").drop("_n").withColumn(f"{p}here", F.lit(True))

    m = one(a, "a_").join(one(b, "b_"), key, "full_outer")
    both = F.col("a_here").isNotNull() & F.col("b_here").isNotNull()
    changes = F.array_compact(F.array(
        F.when(F.col("a_here").isNull(), F.lit("added")), F.when(F.col("b_here").isNull(), F.lit("removed")),
        *[F.when(both & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in ("level", "kind", "parent")],
    ))
    return m.select(*key, F.explode(changes).alias("change"))


def zip_score(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """matched, predicted, gold, precision, recall, level_accuracy of headings paired by place on their page.

    Both: book_id, page, seq, level.
    """
    w = Window.partitionBy("book_id", "page").orderBy("seq")
    p, g = (x.select("book_id", "page", "level", F.row_number().over(w).alias("place")) for x in (predicted, gold))
    m = p.withColumnRenamed("level", "_l").withColumn("_p", F.lit(1)).join(g.withColumn("_g", F.lit(1)), ["book_id", "page", "place"], "full_outer")
    hit = F.col("_p").isNotNull() & F.col("_g").isNotNull()
    n, a, b = F.count_if(hit), F.count("_p"), F.count("_g")
    return m.agg(
        n.alias("matched"), a.alias("predicted"), b.alias("gold"), F.round(n / F.nullif(a, F.lit(0)), 6).alias("precision"), F.round(n / F.nullif(b, F.lit(0)), 6).alias("recall"),
        F.round(F.count_if(hit & (F.col("_l") == F.col("level"))) / F.nullif(n, F.lit(0)), 6).alias("level_accuracy"),
    )


def outline(nodes: DataFrame) -> DataFrame:
    """id, line: one indented line per heading with its page."""
    pad = F.repeat(F.lit("  "), F.greatest(F.coalesce("level", F.lit(1)) - 1, F.lit(0)))
    return nodes.where("not ignored").select("id", F.concat(pad, F.lit("- "), F.coalesce("title_source", F.lit("")), F.coalesce(F.concat(F.lit(" (p. "), F.col("page_json").cast("string"), F.lit(")")), F.lit(""))).alias("line"))


def briefs(nodes: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments by parent node: chapter_id, title, first_page, last_page, segments, translatable, brief_hash; unattached ones by zone."""
    t = nodes.select(F.col("id").alias("_node"), "title_source")
    key = F.coalesce("parent_node_id", F.concat(F.lit("zone:"), F.coalesce("zone", F.lit(""))))
    s = segments.withColumn("chapter_id", key).groupBy("chapter_id").agg(
        F.min("page_json").alias("first_page"), F.max("page_json").alias("last_page"), F.count("*").alias("segments"), F.count_if("translatable").alias("translatable")
    )
    met = s.join(t, F.col("chapter_id") == F.col("_node"), "left")
    return met.select("chapter_id", F.col("title_source").alias("title"), "first_page", "last_page", "segments", "translatable",
                      tx.digest(F.col("chapter_id"), F.col("title_source"), F.col("first_page"), F.col("last_page"), F.col("segments")).alias("brief_hash"))
