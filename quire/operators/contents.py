"""Contents pages, numbered trees, protected tokens, glossaries in use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import phrases

#: The kinds of entries by their labels.
_PART, _CHAPTER = r"(?i)^(?:part|teil|book|volume)\s+\S", r"(?i)^(?:chapter|kapitel)\s+\S|^\d+[.)]?\s"
_FRONT = r"(?i)^(?:preface|foreword|introduction|acknowledge?ments?|vorwort|einleitung|préface)"
_BACK = r"(?i)^(?:notes|bibliography|references|index|appendix|literatur|register|anhang)"


def parse_entries(lines: DataFrame) -> DataFrame:
    """book_id, entry_index, title, page_label, print_page, kind of the entries on contents pages.

    lines: book_id, seq, line. A line ending in a number or roman numeral, after dots or
    blanks, closes an entry; lines before it without one are its beginning.
    A title seen before with its page goes.
    """
    end = r"^(.*?)[\s.·…_]*(?:\s|\.{2,}|…)\s*(\d{1,4}|[ivxlcdm]{1,7})\s*$"
    t = tx.squeeze(F.col("line"))
    rows = lines.where(F.col("line").isNotNull() & (t != "")).select("book_id", "seq", t.alias("line"))
    closes = F.col("line").rlike(end)
    w = Window.partitionBy("book_id").orderBy("seq")
    grouped = rows.withColumn("_c", closes).withColumn("_g", F.coalesce(F.sum(F.col("_c").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    parts = F.array_sort(F.collect_list(F.struct("seq", "line")))
    whole = grouped.groupBy("book_id", "_g").agg(F.array_join(F.transform(parts, lambda p: p["line"]), " ").alias("line"), F.max("seq").alias("seq"))
    label = F.regexp_extract("line", end, 2)
    title = F.when(F.col("line").rlike(end), F.trim(F.regexp_extract("line", end, 1))).otherwise(F.col("line"))
    entry = whole.select("book_id", "seq", F.regexp_replace(title, r"[\s.·…_]+$", "").alias("title"), F.nullif(label, F.lit("")).alias("page_label"))
    kind = F.when(F.col("title").rlike(_PART), "part").when(F.col("title").rlike(_FRONT), "front").when(F.col("title").rlike(_BACK), "back").when(F.col("title").rlike(_CHAPTER), "chapter").otherwise("section")
    once = Window.partitionBy("book_id", F.lower("title"), "page_label").orderBy("seq")
    kept = entry.where("title <> ''").withColumn("_n", F.row_number().over(once)).where("_n = 1")
    return kept.select(
        "book_id", (F.row_number().over(w) - 1).alias("entry_index"), "title", "page_label", F.when(F.col("page_label").rlike(r"^\d"), F.col("page_label").try_cast("int")).alias("print_page"), kind.alias("kind")
    )


def merge_entries(parsed: DataFrame, confirmed: DataFrame, least: float = 0.68) -> DataFrame:
    """book_id, title, page_label, origin: confirmed entries take the parsed row most alike, each once; parsed rows left over follow.

    Both: book_id, ordinal, title, page_label. Equal pages add 0.06 to the likeness.
    """
    from quire.functions.similarity import title_similarity

    c = confirmed.select("book_id", F.col("ordinal").alias("co"), F.col("title").alias("ct"), F.col("page_label").alias("cp"))
    p = parsed.select("book_id", F.col("ordinal").alias("po"), F.col("title").alias("pt"), F.col("page_label").alias("pp"))
    score = title_similarity(F.col("ct"), F.col("pt")) + F.when(F.col("cp") == F.col("pp"), 0.06).otherwise(0.0)
    scored = c.join(p, "book_id").withColumn("score", score).where(F.col("score") >= least).select("book_id", "co", "po", "score")

    def take(g: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for co, rows in g.sort_values(["co", "score", "po"], ascending=[True, False, True]).groupby("co", sort=True):
            for po in rows["po"]:
                if po not in used:
                    used.add(po)
                    out.append((g["book_id"].iat[0], co, po))
                    break
        return pd.DataFrame(out, columns=["book_id", "co", "po"])

    pairs = scored.groupBy("book_id").applyInPandas(take, "book_id string, co int, po int")
    named = c.join(pairs, ["book_id", "co"], "left").join(p.select("book_id", "po", "pp"), ["book_id", "po"], "left")
    first = named.select("book_id", F.col("co").alias("ordinal"), F.col("ct").alias("title"), F.coalesce("cp", "pp").alias("page_label"), F.lit("confirmed").alias("origin"))
    rest = p.join(pairs, ["book_id", "po"], "left_anti").select("book_id", F.col("po").alias("ordinal"), F.col("pt").alias("title"), F.col("pp").alias("page_label"), F.lit("parsed").alias("origin"))
    return first.unionByName(rest)


def numbered_parents(headings: DataFrame) -> DataFrame:
    """id, parent: a decimal number's parent is the latest heading before it that carries its prefix within the chapter.

    headings: id, book_id, seq, kind, path (array of numbers, null without). Without such a prefix the
    parent is the chapter, for a chapter the part.
    """
    w = Window.partitionBy("book_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    h = headings.withColumns({
        "_part": F.last(F.when(F.col("kind") == "part", F.col("id")), True).over(w), "_chapter": F.last(F.when(F.col("kind") == "chapter", F.col("id")), True).over(w),
    })
    up = F.when(F.size("path") > 1, F.array_join(F.slice("path", 1, F.size("path") - 1), "."))
    child = h.withColumn("_up", F.when(~F.col("kind").isin("part", "chapter"), up))
    own = h.where("path is not null").select("book_id", F.col("_chapter").alias("_c"), F.array_join("path", ".").alias("_up"), F.col("seq").alias("_s"), F.col("id").alias("_id"))
    near = child.join(own, (child.book_id == own.book_id) & child._chapter.eqNullSafe(own._c) & (child._up == own._up) & (own._s < child.seq)).groupBy("id").agg(F.max_by("_id", "_s").alias("_near"))
    plain = F.when(F.col("kind") == "part", None).when(F.col("kind") == "chapter", F.col("_part")).otherwise(F.coalesce("_chapter", "_part"))
    return h.join(near, "id", "left").select("id", F.coalesce("_near", plain).alias("parent"))


def normal_levels(placed: DataFrame, kinds: DataFrame) -> DataFrame:
    """id, level: book 1, part, front and back 2, chapter 2 or 3 under a part, sections below their parent, at most 6.

    placed: node_id and path from the root (see operators.hierarchy.paths); kinds: id, kind. A level follows from the kinds along the path.
    """
    steps = placed.select(F.col("node_id").alias("id"), F.posexplode("path").alias("_at", "_on")).join(kinds.select(F.col("id").alias("_on"), "kind"), "_on")
    path = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_at", "kind"))).alias("k"))

    def deeper(level: Column, x: Column) -> Column:
        kind = x["kind"]
        return (
            F.when(kind == "book", 1).when(kind.isin("part", "front", "back"), 2).when(kind == "chapter", F.when(F.exists("k", lambda y: (y["kind"] == "part") & (y["_at"] < x["_at"])), 3).otherwise(2))
            .when(kind == "part_intro", 3).otherwise(F.least(level + 1, F.lit(6)))
        )

    return path.select("id", F.aggregate("k", F.lit(0), deeper).alias("level"))


def page_windows(candidates: DataFrame, width: int = 40, least: int = 20) -> DataFrame:
    """book_id, window_no, first_page, last_page: runs of pages no wider than width, cut at a change of zone once they have the least width.

    candidates: book_id, page, zone. A window depends on where the one before it ended, so pages (not
    candidates) of one book are cut in one ordered pass.
    """
    pages = candidates.groupBy("book_id", "page").agg(F.min("zone").alias("zone"))

    def cut(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("page", ignore_index=True)
        out, first, last, zone = [], None, None, None
        for page, z in zip(p["page"], p["zone"]):
            if first is not None and (page - first >= width or z != zone and last - first + 1 >= least):
                out.append((first, last))
                first = None
            if first is None:
                first = page
            last, zone = page, z
        out.append((first, last))
        return pd.DataFrame([(p["book_id"].iat[0], i, int(a), int(b)) for i, (a, b) in enumerate(out)], columns=["book_id", "window_no", "first_page", "last_page"])

    return pages.groupBy("book_id").applyInPandas(cut, "book_id string, window_no int, first_page int, last_page int")


STRUCTURAL = r"\[\^[^\]]+\]|<!--.*?-->|https?://[^\s\])。，；]+|\$\s*\^\{?\d+\}?\s*\$"


def token_order(pairs: DataFrame) -> DataFrame:
    """segment_id, same_tokens, same_pipes: whether structural tokens come in the same order, white space in them aside."""
    tokens = lambda c: F.transform(F.regexp_extract_all(c, F.lit(STRUCTURAL), 0), lambda x: F.regexp_replace(x, r"[\s.,;:!?)\]。，；：！？）】]+$|\s+", ""))
    pipes = lambda c: F.regexp_count(c, F.lit(r"\|"))
    return pairs.select("segment_id", (tokens(F.col("source_text")) == tokens(F.col("target"))).alias("same_tokens"), ((F.col("kind") != "table") | (pipes(F.col("source_text")) == pipes(F.col("target")))).alias("same_pipes"))


def balanced(c: Column) -> Column:
    """Whether protected tokens ⟦name⟧ … ⟦/name⟧ nest properly; ⟦name/⟧ stands alone."""
    marks = F.regexp_extract_all(c, F.lit("⟦[^⟧]*⟧"), 0)
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(True).alias("ok"))

    def step(s: Column, m: Column) -> Column:
        name = F.regexp_replace(m, "^⟦/?|/?⟧$", "")
        top = F.try_element_at(s["open"], F.lit(-1))
        alone, closing = m.endswith("/⟧"), m.startswith("⟦/")
        left = F.slice(s["open"], F.lit(1), F.greatest(F.size(s["open"]) - 1, F.lit(0)))
        return F.struct(
            F.when(alone, s["open"]).when(closing, left).otherwise(F.concat(s["open"], F.array(name))).alias("open"), (s["ok"] & (alone | ~closing | F.coalesce(top == name, F.lit(False)))).alias("ok")
        )

    return F.aggregate(marks, start, step, lambda s: s["ok"] & (F.size(s["open"]) == 0))


def governing_sense(senses: Column) -> Column:
    """The sense named default, else the one of the highest version. senses: array of sense_id, translation, version."""
    named = F.filter(senses, lambda s: s["sense_id"] == "default")
    latest = F.array_max(F.transform(senses, lambda s: F.struct(s["version"].alias("version"), s["sense_id"].alias("sense_id"), s["translation"].alias("translation"))))
    first = F.try_element_at(named, F.lit(1))
    return F.when(first.isNotNull(), F.struct(first["version"].alias("version"), first["sense_id"].alias("sense_id"), first["translation"].alias("translation"))).otherwise(latest)


def _held(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """The pairs, each with every glossary term that stands in its source and whose first word is a word of it."""
    near = phrases.met(pairs.select("segment_id", "source_text"), glossary.select("term"), "segment_id")
    first = F.try_element_at(phrases.tokens(F.col("term")), F.lit(1))
    there = F.contains(F.lower("source_text"), F.lower("term")) & F.array_contains(phrases.tokens(F.col("source_text")), first)
    return pairs.join(near, "segment_id").where(there)


def glossary_in_use(pairs: DataFrame, glossary: DataFrame, limit: int = 40) -> DataFrame:
    """segment_id, term, rank: glossary terms that stand in a source, longest first, at most limit per segment (a prompt's limit)."""
    hit = _held(pairs, glossary).select("segment_id", "term").distinct()
    w = Window.partitionBy("segment_id").orderBy(F.desc(F.length("term")), "term")
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _kept() -> Column:
    """Whether a target has what the glossary wants."""
    return F.when(F.col("constraint") == "keep", F.contains("target", "term")).otherwise(F.contains("target", "translation"))


def term_audit(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """segment_id, term, check: violations of a glossary in translations.

    glossary: term, translation, constraint (hard, preferred, keep). The first use of a
    term in order of ordinal is checked as first_occurrence, later ones as hard_violation or suspicious_context;
    keep wants the term itself. pairs: segment_id, ordinal, source_text, target.
    """
    used = glossary_in_use(pairs, glossary, 1 << 30).drop("rank").join(glossary, "term").join(pairs.select("segment_id", "ordinal", "target"), "segment_id")
    w = Window.partitionBy("term").orderBy("ordinal", "segment_id")
    check = F.when(F.col("constraint") == "keep", "do_not_translate").when(F.col("constraint") == "hard", "hard_violation").when(F.col("_n") == 1, "first_occurrence").otherwise("suspicious_context")
    return used.withColumn("_n", F.row_number().over(w)).where(~_kept()).select("segment_id", "term", check.alias("check"))


def success_rate(pairs: DataFrame, glossary: DataFrame) -> DataFrame:
    """uses, violations, rate of glossary terms kept; 1 when none is used; one row."""
    used = _held(pairs, glossary).select("segment_id", "term", "target").join(glossary, "term").groupBy("segment_id", "term").agg(F.count_if(~_kept()).alias("_v"))
    n = used.agg(F.count("*").alias("uses"), F.coalesce(F.sum("_v"), F.lit(0)).alias("violations"))
    return n.select("uses", "violations", F.round(F.when(F.col("uses") == 0, 1.0).otherwise(1 - F.col("violations") / F.col("uses")), 6).alias("rate"))
