"""Queries on pages and heading trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import structure as st
from quire.runtime import table


def _blocks(spark, d):
    return table(spark, d, "blocks").drop("exported_at").distinct()


def _nodes(spark, d):
    return table(spark, d, "nodes").select("id", "book_id", "kind", "level", "title_source", "page_json", "parent_id", "block_id", "zone", "evidence", "ignored").distinct()


def _segments(spark, d):
    return table(spark, d, "segments").select("id", "book_id", "kind", "source_text", "page_json", "zone", "parent_node_id", "level", "translatable").distinct()


def block_keys(spark, d):
    """Content-addressed ids."""
    return st.block_ids(_blocks(spark, d))


def heading_text(spark, d):
    """Heading functions over the titles of all nodes."""
    t = F.col("title_source")
    n = F.col("_numbering")
    titles = table(spark, d, "nodes").where("title_source is not null").groupBy("id").agg(F.min("title_source").alias("title_source"))
    return titles.withColumn("_numbering", tx.numbering(t)).select(
        "id", tx.canonical_heading(t).alias("canonical"), n["token"].alias("token"), n["family"].alias("family"), n["depth"].alias("depth"), tx.rejection_reason(t).alias("rejected"),
        tx.is_label_only(t).alias("label_only"), tx.normalized_title(t).alias("normalized"), tx.zone_of_heading(t).alias("zone_word"),
    )


def block_text(spark, d):
    """Cleaned content, hashes and footnote parts of all blocks."""
    c = F.col("content")
    return _blocks(spark, d).where("content is not null").select(
        "id", tx.clean_content(c).alias("cleaned"), tx.source_level(c).alias("hashes"), tx.block_text(c, F.col("label")).alias("body"),
        tx.footnote_number(c).alias("note_number"), F.size(tx.roman_tokens(c)).alias("romans"), tx.digest(F.col("id"), c).alias("sha"),
    )


def page_offsets(spark, d):
    """Printed page numbers against page indexes."""
    return st.page_offsets(_blocks(spark, d))


def running_heads(spark, d):
    """Header titles that run through a book."""
    return st.running_heads(_blocks(spark, d))


def repeated_headers(spark, d):
    """Header titles printed at least three times."""
    return st.repeated_headers(_blocks(spark, d), 3)


def page_zones(spark, d):
    """Zone of every page."""
    return st.page_zones(_blocks(spark, d))


def alignment_candidates(spark, d):
    """Blocks that may be headings."""
    b = _blocks(spark, d)
    return st.alignment_candidates(b, st.toc_pages(b))


def text_candidates(spark, d):
    """Short text blocks that stand free."""
    return st.text_candidates(_blocks(spark, d))


def visual_context(spark, d):
    """Headings in or beside pictures and tables."""
    return st.visual_context(_blocks(spark, d))


def heading_candidates(spark, d):
    """Heading blocks merged by page and title."""
    return st.merge_candidates(_blocks(spark, d))


def repetition_nearby(spark, d):
    """How often titles come again."""
    return st.repetition(st.merge_candidates(_blocks(spark, d)).select("book_id", "page_index", "title"))


def numbering_summary(spark, d):
    """Families of numbering."""
    return st.numbering_summary(_nodes(spark, d).where("title_source is not null"), "title_source")


def block_context(spark, d):
    """Neighbouring blocks."""
    return st.block_context(_blocks(spark, d))


def stitch_fragments(spark, d):
    """Paragraphs joined over page breaks."""
    b = _blocks(spark, d).where("label = 'text' and content is not null")
    return st.stitch(b.select("id", F.col("book_id").alias("parent"), F.lit("").alias("zone"), F.col("page_index").alias("page"), F.col("block_index").alias("ordinal"), tx.squeeze(F.col("content")).alias("text")))


def heading_parent(spark, d):
    """Parent by the heading stack."""
    return st.stack_parents(_nodes(spark, d).where("level between 1 and 6").select("id", "book_id", F.struct(F.coalesce("page_json", F.lit(-1)).alias("p"), "id").alias("seq"), "level"))


def node_survivors(spark, d):
    """Nodes kept of equal ones."""
    return st.keep_first(_nodes(spark, d))


def node_redirects(spark, d):
    """Parents after equal nodes went."""
    n = _nodes(spark, d)
    return st.redirect(n, st.keep_first(n))


def apparatus_duplicates(spark, d):
    """Apparatus titles that are main titles."""
    return st.apparatus_duplicates(_nodes(spark, d))


def heading_styles(spark, d):
    """Levels by numbering and height."""
    return st.styles(_blocks(spark, d))


def structure_checks(spark, d):
    """Broken constraints of the heading trees."""
    return st.check_nodes(_nodes(spark, d))


def structure_metrics(spark, d):
    """Broken constraints by code."""
    return st.check_nodes(_nodes(spark, d)).groupBy("code").agg(F.count("*").alias("nodes"))


def tree_diff(spark, d):
    """Declared tree against the tree by the heading stack."""
    n = _nodes(spark, d).where("level between 1 and 6")
    stack = st.stack_parents(n.select("id", "book_id", F.struct(F.coalesce("page_json", F.lit(-1)).alias("p"), "id").alias("seq"), "level"))
    a = n.select("id", "level", "kind", F.nullif(F.lower(F.trim("parent_id")), F.lit("")).alias("parent"))
    return st.tree_diff(a, n.select("id", "level", "kind").join(stack, "id"), ["id"])


def zip_score(spark, d):
    """Nodes against title blocks, by place on the page."""
    p = _nodes(spark, d).where("page_json is not null").select("book_id", F.col("page_json").alias("page"), F.col("id").alias("seq"), "level")
    g = _blocks(spark, d).where("label in ('doc_title', 'paragraph_title')").select("book_id", F.col("page_index").alias("page"), F.struct("block_index", "id").alias("seq"), F.coalesce(tx.source_level(F.col("content")), F.lit(1)).alias("level"))
    return st.zip_score(p, g)


def outline(spark, d):
    """Indented outline."""
    return st.outline(_nodes(spark, d))


def chapter_briefs(spark, d):
    """Segments by chapter."""
    return st.briefs(_nodes(spark, d), _segments(spark, d))


def cleaning_metrics(spark, d):
    """Segments by kind, by zone and in all, in one pass."""
    return _segments(spark, d).groupingSets([["kind"], ["zone"], []], "kind", "zone").agg(F.grouping_id().alias("level"), F.count("*").alias("segments"))


QUERIES = {
    f.__name__: f
    for f in (
        block_keys, heading_text, block_text, page_offsets, running_heads, repeated_headers, page_zones, alignment_candidates, text_candidates, visual_context, heading_candidates, repetition_nearby,
        numbering_summary, block_context, stitch_fragments, heading_parent, node_survivors, node_redirects, apparatus_duplicates, heading_styles, structure_checks, structure_metrics, tree_diff, zip_score,
        outline, chapter_briefs, cleaning_metrics,
    )
}

_SQ = lambda c: f"trim(regexp_replace({c}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"
_UN = lambda c: f"replace(replace(replace(replace(replace(replace(replace({c}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"
_CAN = lambda c: _SQ(f"regexp_replace({_UN(f"regexp_replace(regexp_replace(trim({c}), '^(?:\\s*#{{1,6}}\\s*)+', ''), '<[^>]+>', ' ', 'g')")}, '^\\$?\\s*\\\\?underline\\s*\\{{([^{{}}]+)\\}}\\s*\\$?', '\\1')")
_CLEAN = lambda c: _SQ(f"regexp_replace({c}, '^(?:\\s*#{{1,6}}\\s*)+', '')")
_LAB = "(?i)^(part|teil|book|volume|chapter|kapitel)\\s+([ivxlcdm]+|\\d+|one|two|three|four|five|six|seven|eight|nine|ten)\\b[:.]?\\s*(.*)$"
_DEC, _LET, _SIM, _SEC = "^(\\d+(?:\\.\\d+){1,5})(?:[.)])?\\s+(.+)$", "^([A-Za-z])(?:[.)])\\s+(.+)$", "(?i)^(\\d+|[IVXLCDM]+)(?:[.)])?\\s+(.+)$", "(?i)^§\\s*([0-9Il|]+)$"
_FAM = lambda h: f"""case when regexp_matches({h}, '{_SEC}') then 'section_symbol' when regexp_matches({h}, '{_LAB}') then lower(regexp_extract({h}, '{_LAB}', 1))
  when regexp_matches({h}, '{_DEC}') then 'decimal' when regexp_matches({h}, '{_LET}') then case when regexp_matches({h}, '^[A-Z]') then 'upper_letter' else 'lower_letter' end
  when regexp_matches({h}, '{_SIM}') then 'simple' end"""  # noqa: E731
_TOK = lambda h: f"""case when regexp_matches({h}, '{_SEC}') then '§' || translate(regexp_extract({h}, '{_SEC}', 1), 'Iil|', '1111') when regexp_matches({h}, '{_LAB}') then regexp_extract({h}, '{_LAB}', 2)
  when regexp_matches({h}, '{_DEC}') then regexp_extract({h}, '{_DEC}', 1) when regexp_matches({h}, '{_LET}') then regexp_extract({h}, '{_LET}', 1) when regexp_matches({h}, '{_SIM}') then regexp_extract({h}, '{_SIM}', 1) end"""  # noqa: E731
_WC = lambda h: f"case when {_SQ(h)} = '' then 0 else len(string_split({_SQ(h)}, ' ')) end"
_REJ = lambda h: f"""case when {h} = '' then 'empty' when regexp_full_match({h}, '[\\s*~◇◆△▲▽▼○●□■·•—–_\\-=]+') then 'decorative_only'
  when regexp_matches({h}, '(?i)^(?:p(?:age)?\\.?\\s*)?[ivxlcdm\\d]+$') then 'folio_or_numeric_only' when length({h}) > 180 then 'too_long' when {_WC(h)} > 24 then 'sentence_like'
  when coalesce({_FAM(h)}, '') in ('part','chapter','book','volume','teil','kapitel') then null when regexp_matches({h}, '[?!。？！]$') and {_WC(h)} > 7 then 'quotation_or_sentence' end"""  # noqa: E731
_NT = lambda c: f"regexp_replace(trim(regexp_replace(lower(regexp_replace(regexp_replace(trim(regexp_replace({c}, '^\\s*(?:\\d+(?:\\.\\d+)*|[IVXLCDM]+)[.)]?\\s+', '')), '^(?:\\s*#{{1,6}}\\s*)+', ''), '(?i)^(?:part|book|volume|teil)\\s+(?:\\d+|[ivxlcdm]+)\\s*[:.·–—-]*\\s*', '')), '[^\\pL\\pN_]+', ' ', 'g')), '^list of\\s+', '')"
_ZONE = lambda h: f"""case when lower({h}) in ('notes','endnotes','anmerkungen','注释','注') then 'notes' when lower({h}) in ('references','bibliography','works cited','literatur','literaturverzeichnis','参考文献') then 'bibliography'
  when lower({h}) in ('index','name index','subject index','personenregister','sachregister','namenregister','索引') then 'index' end"""  # noqa: E731
_B = "b as (select distinct * exclude (exported_at) from blocks)"
_N = "n as (select distinct id, book_id, kind, level, title_source, page_json, parent_id, block_id, zone, evidence, ignored from nodes)"
_HEADS = f"heads as (select book_id, lower({_CAN('content')}) as title, page_index from b where label = 'header')"
_SIDE = lambda i: f"coalesce(bbox[{i}], 0.0)"
_NB = lambda i: f"({_SIDE(i)} / case when coalesce({'page_width' if i in (1, 3) else 'page_height'}, 0) = 0 then 1.0 else {'page_width' if i in (1, 3) else 'page_height'} end)"
_STACK = """stack as (select a.id, (select arg_max(p.id, (coalesce(p.page_json, -1), p.id)) from n p where p.book_id = a.book_id and p.level between 1 and 6 and p.level < a.level
  and (coalesce(p.page_json, -1), p.id) < (coalesce(a.page_json, -1), a.id)) as parent from n a where a.level between 1 and 6)"""
_SURV = f"surv as (select id, case when coalesce({_NT('title_source')}, '') = '' then id else first_value(id) over (partition by book_id, {_NT('title_source')}, page_json, zone order by id) end as survivor from n)"
_CHECK = f"""m as (select c.*, p.id as pid, p.level as plevel, p.page_json as ppage, nullif(lower(trim(c.parent_id)), '') as parent, {_CAN('c.title_source')} as h, {_NT('c.title_source')} as t,
  count(*) over (partition by c.book_id, {_NT('c.title_source')}, c.page_json) as same, count(*) over (partition by c.block_id) as occ from n c left join n p on p.id = nullif(lower(trim(c.parent_id)), '')),
codes as ({' union all '.join(f"select id as node_id, '{k}' as code from m where {w}" for k, w in (
    ('missing_parent', 'parent is not null and pid is null'), ('missing_provenance', 'block_id is null and coalesce(len(evidence), 0) = 0'), ('suspicious_heading_text', f'({_REJ("h")}) is not null'),
    ('main_heading_in_apparatus', "kind in ('part','chapter') and zone in ('notes','bibliography','index')"), ('heading_level_out_of_range', 'level not between 1 and 6'), ('hierarchy_parent_not_shallower', 'plevel >= level'),
    ('level_jump', 'level > plevel + 1'), ('parent_after_child', 'ppage > page_json'), ('duplicate_block_occupation', 'block_id is not null and occ > 1'), ('duplicate_heading', "t <> '' and same > 1"), ('orphan_section', 'parent is null and level >= 3')))})"""
_MERGED = f"""merged as (select book_id, page_index, lower({_CAN('content')}) as title, list_sort(list(distinct id)) as block_ids, list_sort(list(distinct label)) as labels,
  arg_min(label, (case label when 'doc_title' then 0 when 'paragraph_title' then 1 else 2 end, block_index, id)) as strongest, min({_SIDE(1)}) as x1, min({_SIDE(2)}) as y1, max({_SIDE(3)}) as x2, max({_SIDE(4)}) as y2
  from b where label in ('doc_title','paragraph_title','header') and {_CAN('content')} <> '' group by 1, 2, 3)"""
ORACLE = {
    "block_keys": f"with {_B} select id, 'blk-' || left(sha1(concat_ws(chr(31), coalesce(cast(page_index as varchar), 'None'), coalesce(raw_block_id, 'None'), coalesce(cast(block_index as varchar), 'None'), coalesce(label, ''), coalesce(content, ''))), 16) as block_key from b",
    "heading_text": f"""with {_N}, h as (select id, title_source as t, {_CAN('title_source')} as h from n where title_source is not null)
select id, h as canonical, {_TOK('h')} as token, {_FAM('h')} as family, cast(case when ({_FAM('h')}) = 'section_symbol' then 2 when ({_FAM('h')}) = 'decimal' then len(string_split({_TOK('h')}, '.')) when ({_FAM('h')}) is not null then 1 end as integer) as depth,
  {_REJ('h')} as rejected, regexp_matches(h, '{_LAB}') and trim(regexp_extract(h, '{_LAB}', 3)) = '' as label_only, {_NT('t')} as normalized, {_ZONE('h')} as zone_word from h""",
    "page_offsets": f"""with {_B}, o as (select book_id, cast(regexp_extract(content, '(\\d+)', 1) as integer) - page_index as o, page_index from b where label = 'number' and regexp_matches(content, '\\d') and ({_NB(2)} <= 0.12 or {_NB(2)} >= 0.85)),
per as (select book_id, o, count(*) as support, min(page_index) as first from o group by 1, 2)
select book_id, o as page_offset, support, cast(sum(support) over (partition by book_id) as bigint) as observations, round(support / sum(support) over (partition by book_id), 6) as confidence from per
qualify row_number() over (partition by book_id order by support desc, first, o) = 1""",
    "running_heads": f"""with {_B}, {_HEADS}, size as (select book_id, max(page_index) - min(page_index) as span from b group by 1)
select book_id, title, count(*) as printings, min(page_index) as first_page, max(page_index) as last_page from heads join size using (book_id) where title <> '' group by book_id, title, span having count(*) >= 5 and max(page_index) - min(page_index) >= 0.8 * span""",
    "repeated_headers": f"with {_B}, {_HEADS} select book_id, title, count(*) as printings, min(page_index) as first_page from heads where title <> '' group by 1, 2 having count(*) >= 3",
    "page_zones": f"""with {_B}, per as (select book_id, max(page_index) + 1 as pages from b group by 1),
f as (select book_id, page_index, arg_min(z, o) as opened from (select book_id, page_index, coalesce(block_order, block_index) as o, {_ZONE(_CAN('content'))} as z from b where label in ('doc_title','paragraph_title','header')) join per using (book_id)
  where z is not null and page_index >= greatest(5, floor(pages * 0.55)) group by 1, 2)
select book_id, page_index, coalesce(last_value(opened ignore nulls) over (partition by book_id order by page_index rows between unbounded preceding and current row), 'mainmatter') as zone
from (select distinct book_id, page_index from b) left join f using (book_id, page_index)""",
    "alignment_candidates": f"""with {_B}, toc as (select distinct book_id, page_index from b where page_index between 0 and 30 and (regexp_matches(lower({_CAN('content')}), '^(?:table of contents|contents|inhalt|inhaltsverzeichnis|table des matières|目录)$') or label in ('toc','content','catalogue'))),
c as (select *, {_CLEAN('content')} as t, {_CAN('content')} as h from b where content is not null)
select id, book_id, page_index, h as title from c where (label in ('doc_title','paragraph_title','header','vision_heading','vision_heading_unmatched') or (label = 'text' and length(t) between 1 and 180 and {_WC('t')} <= 24
  and not regexp_matches(t, '[.?!;。？！；]$') and {_NB(2)} >= 0.08 and {_NB(4)} <= 0.92)) and ({_REJ('h')}) is null and not exists (select 1 from toc where toc.book_id = c.book_id and toc.page_index = c.page_index)""",
    "heading_candidates": f"with {_B}, {_MERGED} select * from merged",
    "repetition_nearby": f"""with {_B}, {_MERGED} select book_id, page_index, title, count(*) over (partition by book_id, title) as printings,
  count(*) over (partition by book_id, title order by page_index range between 10 preceding and 10 following) as nearby from merged""",
    "numbering_summary": f"""with {_N}, h as (select {_CAN('title_source')} as h from n where title_source is not null), f as (select {_FAM('h')} as family, {_TOK('h')} as token from h)
select family, count(*) as titles, list_sort(list(distinct token))[:5] as tokens from f where family is not null group by 1""",
    "block_context": f"with {_B} select id, left(lag(content) over w, 80) as before, left(lead(content) over w, 80) as after from b window w as (partition by book_id, page_index order by block_index, id)",
    "heading_parent": f"with {_N}, {_STACK} select id, parent from stack",
    "node_survivors": f"with {_N}, {_SURV} select id, survivor from surv",
    "node_redirects": f"with {_N}, {_SURV} select n.id, coalesce(q.survivor, n.parent_id) as parent_id from n join surv s on s.id = n.id and s.survivor = s.id left join surv q on q.id = n.parent_id",
    "apparatus_duplicates": f"""with {_N}, t as (select id, book_id, zone, kind, trim(regexp_replace(lower(title_source), '[^\\pL\\pN_]+', ' ', 'g')) as t from n where title_source is not null)
select id from t a where zone in ('notes','bibliography','index') and exists (select 1 from t m where m.book_id = a.book_id and m.t = a.t and m.zone = 'mainmatter' and m.kind in ('part','chapter','section'))""",
    "structure_checks": f"with {_N}, {_CHECK} select node_id, code from codes",
    "structure_metrics": f"with {_N}, {_CHECK} select code, count(*) as nodes from codes group by 1",
    "tree_diff": f"""with {_N}, {_STACK} select n.id, 'parent' as change from n join stack s using (id) where nullif(lower(trim(parent_id)), '') is distinct from s.parent""",
    "outline": f"with {_N} select id, repeat('  ', greatest(coalesce(level, 1) - 1, 0)) || '- ' || coalesce(title_source, '') || coalesce(' (p. ' || page_json || ')', '') as line from n where not ignored",
    "cleaning_metrics": """with s as (select distinct id, kind, zone from segments) select kind, zone, cast(grouping_id(kind, zone) as bigint) as level, count(*) as segments from s group by grouping sets ((kind), (zone), ())""",
    "zip_score": f"""with {_B}, {_N}, p as (select book_id, page_json as page, level, row_number() over (partition by book_id, page_json order by id) as place from n where page_json is not null),
g as (select book_id, page_index as page, coalesce(nullif(length(regexp_extract(ltrim(content), '^(#+)', 1)), 0), 1) as level, row_number() over (partition by book_id, page_index order by block_index, id) as place from b where label in ('doc_title','paragraph_title')),
m as (select p.level as pl, g.level as gl, p.place is not null as hp, g.place is not null as hg from p full join g on p.book_id = g.book_id and p.page = g.page and p.place = g.place)
select count(*) filter (where hp and hg) as matched, count(*) filter (where hp) as predicted, count(*) filter (where hg) as gold, round(count(*) filter (where hp and hg) / count(*) filter (where hp), 6) as precision,
  round(count(*) filter (where hp and hg) / count(*) filter (where hg), 6) as recall, round(count(*) filter (where hp and hg and pl = gl) / count(*) filter (where hp and hg), 6) as level_accuracy from m""",
}
