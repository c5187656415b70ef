"""Queries on contents, numbered trees and glossaries, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import contents
from quire.operators.hierarchy import hierarchy, paths
from quire.runtime import cut, table


def _nodes(spark, d):
    return table(spark, d, "nodes").select("id", "book_id", "kind", "level", "title_source", "page_json", "page_print", "parent_id", "zone", "numbering_path").distinct()


def _pairs(spark, d):
    s = table(spark, d, "segments").select("id", "kind", "source_text", "book_id").distinct()
    t = table(spark, d, "translations").where("status = 'completed' and translated_text is not null").groupBy("segment_id").agg(F.max_by("translated_text", "record_no").alias("target"))
    return s.where("source_text is not null").join(t, s.id == t.segment_id).select("segment_id", "book_id", "kind", "source_text", "target", F.col("id").alias("ordinal"))


def contents_entries(spark, d):
    """Contents lines made of the outline, parsed back."""
    w = Window.partitionBy("book_id").orderBy("page_json", "id")
    lines = _nodes(spark, d).where("title_source is not null and page_json is not null").select("book_id", F.row_number().over(w).alias("seq"), F.concat("title_source", F.lit(" ..... "), F.col("page_json").cast("string")).alias("line"))
    return contents.parse_entries(lines)


def numbered_parents(spark, d):
    """Parents by numbering."""
    h = _nodes(spark, d).select("id", "book_id", "kind", F.struct(F.coalesce("page_json", F.lit(-1)).alias("p"), "id").alias("seq"), F.when(F.size("numbering_path") > 0, F.col("numbering_path")).alias("path"))
    return contents.numbered_parents(h)


def normal_levels(spark, d):
    """Levels by kinds along the path."""
    nodes = table(spark, d, "nodes")
    placed = cut(paths(hierarchy(nodes)))
    return contents.normal_levels(placed, _nodes(spark, d).select("id", "kind"))


def page_windows(spark, d):
    """Windows of pages over the nodes."""
    return contents.page_windows(_nodes(spark, d).where("page_json is not null").select("book_id", F.col("page_json").alias("page"), F.coalesce("zone", F.lit("")).alias("zone")))


def token_order(spark, d):
    """Order of structural tokens in translations."""
    return contents.token_order(_pairs(spark, d))


def glossary_terms(spark, d):
    """Mined terms in use, by segment."""
    g = table(spark, d, "term_candidates").where("surface is not null").select(F.trim("surface").alias("term")).where("term <> ''").distinct()
    return contents.glossary_in_use(_pairs(spark, d), g).groupBy("segment_id").agg(F.count("*").alias("terms"), F.min_by("term", "rank").alias("longest"))


def term_success(spark, d):
    """Terms kept as they are in translations."""
    g = table(spark, d, "term_candidates").where("surface is not null").select(F.trim("surface").alias("term")).where("term <> ''").distinct()
    g = g.withColumns({"translation": F.col("term"), "constraint": F.lit("keep")})
    return contents.success_rate(_pairs(spark, d), g)


QUERIES = {f.__name__: f for f in (contents_entries, numbered_parents, normal_levels, page_windows, token_order, glossary_terms, term_success)}
_P = """s as (select distinct id, kind, source_text, book_id from segments where source_text is not null),
t as (select segment_id, arg_max(translated_text, record_no) as target from translations where status = 'completed' and translated_text is not null group by 1), p as (select * from s join t on s.id = t.segment_id),
g as (select distinct trim(surface) as term from term_candidates where surface is not null and trim(surface) <> ''),
gw as (select term, regexp_extract_all(lower(term), '[\\pL\\pN_]+')[1] as w from g), pw as (select segment_id, source_text, target, unnest(list_distinct(regexp_extract_all(lower(source_text), '[\\pL\\pN_]+'))) as w from p),
hit as (select distinct segment_id, term, target from pw join gw using (w) where contains(lower(source_text), lower(term)))"""
_TOK = lambda c: f"list_transform(regexp_extract_all({c}, '\\[\\^[^\\]]+\\]|<!--.*?-->|https?://[^\\s\\])。，；]+|\\$\\s*\\^\\{{?\\d+\\}}?\\s*\\$'), lambda x: regexp_replace(x, '[\\s.,;:!?)\\]。，；：！？）】]+$|\\s+', '', 'g'))"
ORACLE = {
    "token_order": f"with {_P} select segment_id, {_TOK('source_text')} = {_TOK('target')} as same_tokens, kind <> 'table' or len(regexp_extract_all(source_text, '\\|')) = len(regexp_extract_all(target, '\\|')) as same_pipes from p",
    "glossary_terms": f"with {_P} select segment_id, count(*) as terms, arg_min(term, (-length(term), term)) as longest from (select * from hit qualify row_number() over (partition by segment_id order by length(term) desc, term) <= 40) group by 1",
    "term_success": f"with {_P} select count(*) as uses, count(*) filter (where not contains(target, term)) as violations, round(1 - count(*) filter (where not contains(target, term)) / count(*), 6) as rate from hit",
}
