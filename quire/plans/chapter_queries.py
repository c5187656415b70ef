"""Queries on chapters, matching and terminology, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.hierarchy_queries import _walk
from quire.operators import chapters as ch
from quire.operators import incremental as inc
from quire.operators import terminology as term
from quire.runtime import cut, table

#: Constraints of a glossary.
CONSTRAINTS = ["hard", "preferred", "do_not_translate", "first_occurrence", "sense_constrained"]


def _nodes(spark, d):
    return table(spark, d, "nodes").select("id", "book_id", "kind", "level", "title_source", "page_json", "parent_id", "block_id", "ordinal").distinct()


def _segments(spark, d):
    return table(spark, d, "segments").select("id", "parent_node_id", "zone", "page_json", "translatable", "metadata").distinct()


def _pairs(spark, d):
    s = table(spark, d, "segments").select("id", "source_text").distinct()
    t = table(spark, d, "translations").where("status = 'completed' and translated_text is not null").groupBy("segment_id").agg(F.max_by("translated_text", "record_no").alias("target"))
    return s.join(t, s.id == t.segment_id).select("segment_id", F.col("segment_id").alias("ordinal"), "source_text", "target")


def _concepts(spark, d):
    """Every mined term as a concept that keeps its form, constraints in turn; every seventh has a second, lower-case form."""
    t = table(spark, d, "term_candidates").where("surface is not null").select(F.trim("surface").alias("term")).where("term <> ''").distinct()
    n = F.length("term")
    first = t.select(F.col("term").alias("concept_id"), F.col("term").alias("place"), F.array("term").alias("surfaces"), F.get(F.array(*map(F.lit, CONSTRAINTS)), n % 5).alias("constraint"), F.col("term").alias("translation"))
    second = t.where(n % 7 == 0).select(
        F.concat("term", F.lit("#2")).alias("concept_id"), F.concat("term", F.lit("#2")).alias("place"), F.array("term").alias("surfaces"), F.lit("preferred").alias("constraint"), F.lower("term").alias("translation")
    )
    return first.unionByName(second)


def _judged(spark, d):
    return cut(term.judged_uses(term.concept_uses(_pairs(spark, d), _concepts(spark, d))))


def qa2_flags(spark, d):
    """Flags of the terminology audit."""
    return term.terminology_flags(_judged(spark, d))


def qa2_metrics(spark, d):
    """Figures of the terminology audit."""
    return term.terminology_metrics(_judged(spark, d))


def node_chapters(spark, d):
    """Nearest chapter and top anchor of every node."""
    return ch.chapter_ancestors(_nodes(spark, d))


def segment_chapters(spark, d):
    """Chapter of every segment."""
    return ch.chapter_keys(_segments(spark, d), _nodes(spark, d)).select("id", "chapter_id")


def chapter_overview(spark, d):
    """What each chapter and zone holds."""
    return ch.chapter_briefs(_segments(spark, d), _nodes(spark, d)).drop("brief_hash")


def _plain(c):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"^[\s#]+", ""), r"\s+", " "))


def _heading_blocks(spark, d):
    b = table(spark, d, "blocks").where("label in ('doc_title', 'paragraph_title')").select("id", "book_id", "page_index", "content").distinct()
    return b.select("id", "book_id", F.col("page_index").alias("page"), _plain(F.col("content")).alias("title"), F.regexp_extract(F.coalesce("content", F.lit("")), r"^\s*(?:#+\s*)?(\d+(?:\.\d+)*)\b", 1).alias("token"))


def candidate_nodes(spark, d):
    """The node each heading block stands for."""
    c = _heading_blocks(spark, d).withColumnRenamed("id", "candidate_id").withColumn("token", F.when(F.col("token") != "", F.col("token")))
    n = _nodes(spark, d).select(F.col("id").alias("node_id"), "book_id", F.col("page_json").alias("page"), _plain(F.col("title_source")).alias("title"), "ordinal", "block_id")
    return ch.first_match(c, n)


def identity_matches(spark, d):
    """Nodes and heading blocks that are the same."""
    n = _nodes(spark, d).select("id", "book_id", "block_id", _plain(F.col("title_source")).alias("title"), F.col("page_json").alias("page"))
    b = _heading_blocks(spark, d).select("id", "book_id", F.col("id").alias("block_id"), "title", "page")
    return ch.identity_match(n, b)


def document_order(spark, d):
    """Place of every node in its book."""
    return ch.document_order(_nodes(spark, d))


def style_clusters(spark, d):
    """Nodes per level with samples."""
    return ch.style_clusters(_nodes(spark, d))


def joined_footnotes(spark, d):
    """Footnotes with their continuations."""
    b = table(spark, d, "blocks").where("label = 'footnote'").select("id", "book_id", "page_index", "block_index", "content").distinct()
    return ch.joined_footnotes(b, F.col("content").rlike(r"^\s*(?:\[\^|\[?\d|[*†])"))


def marked_models(spark, d):
    """Segments whose latest row comes from a draft model."""
    return inc.latest(table(spark, d, "translations").select("segment_id", "record_no", "model"), "segment_id", "record_no").where(F.col("model").rlike(r"(?i)[-_]draft")).select("segment_id", "model")


def token_multisets(spark, d):
    """Whether source and target have the same addresses and note marks, each as often."""
    bag = lambda c, p: F.sort_array(F.regexp_extract_all(F.coalesce(F.col(c), F.lit("")), F.lit(p), 0))
    url, note = r"https?://[^\s<>\"')\]]+", r"\[\^[^\]]+\]"
    return _pairs(spark, d).select("segment_id", (bag("source_text", url) == bag("target", url)).alias("same_urls"), (bag("source_text", note) == bag("target", note)).alias("same_notes"))


QUERIES = {
    f.__name__: f
    for f in (qa2_flags, qa2_metrics, node_chapters, segment_chapters, chapter_overview, candidate_nodes, identity_matches, document_order, style_clusters, joined_footnotes, marked_models, token_multisets)
}

_N = "nd as (select distinct id, book_id, kind, level, title_source, page_json, parent_id, block_id, ordinal from nodes)"
_S = "sg as (select distinct id, parent_node_id, zone, page_json, translatable, metadata from segments)"
_P = """pr as (select s.id as segment_id, coalesce(source_text, '') as source_text, target from (select distinct id, source_text from segments) s
join (select segment_id, arg_max(translated_text, record_no) as target from translations where status = 'completed' and translated_text is not null group by 1) t on s.id = t.segment_id)"""
_CH = f"""{_walk}, {_N}, {_S}, trail as (select node_id, path[:steps + 1] as path from told),
up as (select node_id, unnest(path) as above, generate_subscripts(path, 1) as i from trail),
nearest as (select node_id, arg_min(above, i) as chapter_id from up where above in (select id from nd where kind = 'chapter') group by 1),
anc as (select node_id, chapter_id, case when len(path) > 1 then path[len(path) - 1] end as anchor_id from trail left join nearest using (node_id)),
keyed as (select s.id, s.zone, s.page_json, coalesce(s.translatable, false) as translatable,
  coalesce(a.chapter_id, case when s.metadata.node_kind = 'chapter' and s.metadata.node_id in (select id from nd where kind = 'chapter') then s.metadata.node_id end) as chapter_id
  from sg s left join anc a on a.node_id = s.parent_node_id)"""
_T = lambda c: f"trim(regexp_replace(regexp_replace(lower({c}), '^[\\s#]+', ''), '\\s+', ' ', 'g'))"
_B = f"""hb as (select distinct id, book_id, page_index as page, {_T('content')} as title, nullif(regexp_extract(coalesce(content, ''), '^\\s*(?:#+\\s*)?(\\d+(?:\\.\\d+)*)\\b', 1), '') as token
from blocks where label in ('doc_title', 'paragraph_title'))"""
_Q = f"""with {_P}, tm as (select distinct trim(surface) as term from term_candidates where surface is not null and trim(surface) <> ''),
cs as (select term as concept_id, term as place, term as surface, [{', '.join(f"'{c}'" for c in CONSTRAINTS)}][length(term) % 5 + 1] as kind, term as translation from tm
  union all select term || '#2', term || '#2', term, 'preferred', lower(term) from tm where length(term) % 7 = 0),
fw as (select *, regexp_extract(lower(surface), '[\\pL\\pN_]+') as w from cs), pw as (select *, unnest(list_distinct(regexp_extract_all(lower(source_text), '[\\pL\\pN_]+'))) as w from pr),
us as (select p.segment_id, p.target, c.* , row_number() over (partition by concept_id order by segment_id) = 1 as is_first from pw p join fw c using (w)
  where contains(lower(source_text), lower(surface)) and regexp_matches(lower(source_text), '(^|[^\\pL\\pN_])' || regexp_escape(lower(surface)) || '($|[^\\pL\\pN_])')),
j0 as (select *, translation <> '' and contains(target, translation) as there, contains(target, surface) as kept from us),
j as (select *, case when kind = 'hard' and not there then 'hard_violation' when kind = 'do_not_translate' and not kept then 'do_not_translate'
    when kind = 'first_occurrence' and not is_first and not kept then 'first_occurrence'
    when not there and (kind = 'sense_constrained' or kind = 'first_occurrence' and is_first) then 'suspicious_context' end as flag,
  (kind in ('preferred', 'sense_constrained') or kind = 'hard' and there or kind = 'first_occurrence' and is_first) as applies from j0),
vs as (select surface, translation, row_number() over (partition by surface order by count(*) desc, min((segment_id, place))) as rank from j where applies and there group by 1, 2)"""
ORACLE = {
    "qa2_flags": _Q + """ select segment_id, flag as "check", case when flag in ('hard_violation', 'do_not_translate') then 'high' else 'flag' end as severity, concept_id, surface from j where flag is not null
  union all select segment_id, 'consistency', 'flag', concept_id, surface from j where applies and there and (surface, translation) in (select (surface, translation) from vs where rank > 1)""",
    "qa2_metrics": _Q + """ select count(*) filter (where applies) as applicable, count(*) filter (where applies and there) as matched,
  case when count(*) filter (where applies) = 0 then 1.0 else round(count(*) filter (where applies and there) / count(*) filter (where applies), 6) end as term_success_rate,
  count(*) filter (where flag = 'hard_violation') as hard_violations, count(*) filter (where flag = 'suspicious_context') as suspicious_contexts, (select count(*) from vs where rank > 1) as consistency_flags from j""",
    "node_chapters": _CH + " select node_id, chapter_id, anchor_id from anc",
    "segment_chapters": _CH + " select id, chapter_id from keyed",
    "chapter_overview": _CH + """, sums as (select coalesce(chapter_id, case when translatable then 'zone:' || coalesce(zone, '') end) as k, min(page_json) as a, max(page_json) as b, count(*) as n, count(*) filter (where translatable) as t
  from keyed group by 1 having k is not null),
sec as (select id as node_id, min(title_source) as s, min(page_json) as p from nd where kind = 'section' group by 1),
tit as (select above as id, list(coalesce(s, '') order by coalesce(p, -1), node_id) as titles from up join sec using (node_id) where above <> node_id group by 1),
chs as (select id, min(title_source) as title from nd where kind = 'chapter' group by 1)
select coalesce(c.id, k) as chapter_id, coalesce(c.title, '') as title, case when c.id is not null then 'chapter' else 'zone_bucket' end as kind, coalesce(a, 0) as first_page, coalesce(b, 0) as last_page,
  coalesce(t.titles, []) as section_titles, coalesce(n, 0) as segments, coalesce(s.t, 0) as translatable from (chs c left join tit t using (id)) full join sums s on s.k = c.id""",
    "candidate_nodes": f"""with {_N}, {_B}, n as (select id as node_id, book_id, page_json as page, {_T('title_source')} as title, ordinal, block_id from nd),
m as (select c.id as candidate_id, node_id, case when c.id = n.block_id then 1 when c.page = n.page and c.title = n.title and n.title <> '' then 2 when c.page = n.page and c.token = n.ordinal then 3 end as rule from hb c join n using (book_id))
select candidate_id, arg_min(node_id, (rule, node_id)) as node_id, min(rule) as rule from m where rule is not null group by 1""",
    "identity_matches": f"""with {_N}, {_B}, n as (select id, book_id, block_id, {_T('title_source')} as title, page_json as page from nd),
nu as (select *, count(*) over (partition by book_id, title) as k from n where title <> ''), bu as (select *, count(*) over (partition by book_id, title) as k from hb where title <> ''),
m as (select n.id as left_id, b.id as right_id, 1 as rule from n join hb b on b.book_id = n.book_id and b.id = n.block_id
  union all select n.id, b.id, 2 from nu n join bu b on n.book_id = b.book_id and n.title = b.title where n.k = 1 and b.k = 1
  union all select n.id, b.id, 3 from n join hb b on n.book_id = b.book_id and n.title = b.title and n.page = b.page)
select left_id, arg_min(right_id, (rule, right_id)) as right_id, min(rule) as rule from m group by 1""",
    "document_order": f"with {_N} select id, cast(row_number() over (partition by book_id order by page_json nulls first, level nulls first, id) as integer) as place from nd",
    "style_clusters": f"with {_N} select level, count(*) as rows, list_sort(list(id order by id))[:8] as sample_ids from nd group by 1",
    "joined_footnotes": """with b as (select distinct id, book_id, page_index, block_index, content from blocks where label = 'footnote'),
t as (select *, cast(sum(case when regexp_matches(content, '^\\s*(?:\\[\\^|\\[?\\d|[*†])') then 1 else 0 end) over (partition by book_id, page_index order by block_index, id) as integer) as note_no from b)
select book_id, page_index, note_no, arg_min(id, (block_index, id)) as first_id, string_agg(coalesce(content, ''), ' ' order by block_index, id) as text from t group by 1, 2, 3""",
    "marked_models": "select segment_id, model from (select distinct segment_id, record_no, model from translations) qualify row_number() over (partition by segment_id order by record_no desc) = 1 and regexp_matches(model, '(?i)[-_]draft')",
    "token_multisets": f"""with {_P} select segment_id, list_sort(regexp_extract_all(source_text, 'https?://[^\\s<>"'')\\]]+')) = list_sort(regexp_extract_all(target, 'https?://[^\\s<>"'')\\]]+')) as same_urls,
  list_sort(regexp_extract_all(source_text, '\\[\\^[^\\]]+\\]')) = list_sort(regexp_extract_all(target, '\\[\\^[^\\]]+\\]')) as same_notes from pr""",
}
