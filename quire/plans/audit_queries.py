"""Queries of the audit and of incremental work, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import audit, incremental as inc
from quire.runtime import table


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segments").select("id", "book_id", "source_hash", "kind", "source_text", "page_json", "parent_node_id", "level", "translatable").distinct()


def _last(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """Latest log rows with the columns asked for; what is not asked for is not read."""
    return inc.latest(table(spark, d, "translations").select("segment_id", "record_no", "source_hash", "status", *more), "segment_id", "record_no")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = inc.current(_segments(spark, d), _last(spark, d, "translated_text"))
    return rows.select("segment_id", "kind", F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("translated_text", F.lit("")).alias("target"))


def qa_flags_long(spark, d):
    """All flags of current translations."""
    return audit.all_flags(_pairs(spark, d))


def qa_flags_by_check(spark, d):
    """Flags and flagged segments per stage and check."""
    return audit.all_flags(_pairs(spark, d)).groupBy("stage", "check").agg(F.count("*").alias("flags"), F.count_distinct("segment_id").alias("segments"))


def qa_planted_parity(spark, d):
    """Parity flags of the planted pairs."""
    planted = table(spark, d, "qa_planted_errors").distinct()
    return audit.parity_flags(planted.select(F.col("id").alias("segment_id"), "kind", F.coalesce("source_text", F.lit("")).alias("source_text"), F.coalesce("translated_text", F.lit("")).alias("target")))


def duplicate_targets(spark, d):
    """Segments whose target stands on more than two segments."""
    return audit.duplicate_flags(_pairs(spark, d)).select("segment_id", "actual")


def repeated_sentences(spark, d):
    """Segments with a sentence three times in the target."""
    return _pairs(spark, d).withColumn("sentence", F.explode(audit.repeated_sentences(F.col("target")))).select("segment_id", "sentence")


def residual_runs(spark, d):
    """Longest run of Latin words in each target."""
    return _pairs(spark, d).select("segment_id", tx.residual_run(F.col("target")).alias("run"))


def proper_nouns(spark, d):
    """Capitalized runs of sources that do not survive in the target."""
    lost = F.filter(tx.capitalized_runs(F.col("source_text")), lambda x: ~tx.span_survives(x, F.col("target")))
    return _pairs(spark, d).withColumn("span", F.explode(F.array_distinct(lost))).select("segment_id", "span")


def triage_decisions(spark, d):
    """Flags by stage, check and decision."""
    pairs = _pairs(spark, d)
    return audit.triage(audit.all_flags(pairs), pairs).groupBy("stage", "check", "decision").agg(F.count("*").alias("flags"))


def triage_queue(spark, d):
    """The twenty most urgent segments for a reader."""
    pairs = _pairs(spark, d)
    return audit.human_queue(audit.triage(audit.all_flags(pairs), pairs))


def lww_compaction(spark, d):
    """Latest log row of each segment."""
    return _last(spark, d, "attempt").select("segment_id", "record_no", "status", "attempt", "source_hash")


def pending_work(spark, d):
    """Segments still to be translated."""
    return inc.pending(_segments(spark, d), _last(spark, d)).select("id", "book_id")


def unknown_rows(spark, d):
    """Completed rows of segments that are not there."""
    return inc.unknown_rows(_segments(spark, d), _last(spark, d)).select("segment_id", "record_no")


def coverage_classes(spark, d):
    """missing, stale or current, per segment."""
    return inc.coverage_class(_segments(spark, d), _last(spark, d))


def coverage(spark, d):
    """Coverage of the translatable segments."""
    return inc.coverage(_segments(spark, d), _last(spark, d))


def target_prefix(spark, d):
    """Pending segments to take on to reach a target."""
    last = _last(spark, d)
    return inc.target_prefix(inc.pending(_segments(spark, d), last), last, 1_000_000_000)


def currency_invalidation(spark, d):
    """Whether each latest row is current, with the glossary of its book as dependency."""
    seg = _segments(spark, d)
    log = table(spark, d, "translations").select("segment_id", "record_no", "source_hash", "status", "metadata.prompt_version", "metadata.context_mode", F.col("glossary_sha256").alias("recorded"))
    last = inc.latest(log, "segment_id", "record_no").join(seg.select(F.col("id").alias("segment_id"), "book_id"), "segment_id")
    versions = last.where(F.col("recorded").isNotNull()).groupBy("book_id").agg(F.max_by("recorded", "record_no").alias("version"))
    hashes = seg.select(F.col("id").alias("segment_id"), F.col("source_hash").alias("_hash"))
    return inc.stale_dependencies(last, versions, hashes, "2", "contextual")


def context_windows(spark, d):
    """Two texts before and after each segment of its parent node."""
    return inc.context_windows(_segments(spark, d).where("source_text is not null and parent_node_id is not null"), "parent_node_id", ["page_json", "id"])


def previous_tail(spark, d):
    """End of the translation before each segment of its parent node."""
    seg = _segments(spark, d).where("parent_node_id is not null").select("id", "parent_node_id", "page_json", "source_hash")
    last = _last(spark, d, "translated_text").where("status = 'completed'").select(F.col("segment_id").alias("id"), "source_hash", "translated_text")
    return inc.previous_tail(seg.join(last, ["id", "source_hash"], "left"), "parent_node_id", ["page_json", "id"])


def _planned(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("parent_node_id").orderBy("page_json", "id")
    seg = _segments(spark, d).withColumn("position", F.row_number().over(w))
    todo = seg.where("translatable").select("id", F.col("parent_node_id").alias("chapter"), F.when(F.col("parent_node_id").isNotNull(), F.col("position")).alias("position"), F.col("kind").isin("table", "footnote", "caption").alias("sensitive"), F.length(F.coalesce("source_text", F.lit(""))).alias("size"))
    return inc.plan_batches(todo.withColumn("chapter", F.coalesce("chapter", F.lit(""))))


def micro_batches(spark, d):
    """Batches of consecutive segments."""
    return _planned(spark, d)


def batch_summary(spark, d):
    """Number and size of these batches."""
    return inc.batch_summary(_planned(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        qa_flags_long, qa_flags_by_check, qa_planted_parity, duplicate_targets, repeated_sentences, residual_runs, proper_nouns, triage_decisions, triage_queue,
        lww_compaction, pending_work, unknown_rows, coverage_classes, coverage, target_prefix, currency_invalidation, context_windows, previous_tail, micro_batches, batch_summary,
    )
}

_BASE = """
seg as (select id, any_value(book_id) as book_id, any_value(source_hash) as source_hash, any_value(kind) as kind, any_value(source_text) as source_text,
  any_value(page_json) as page_json, any_value(parent_node_id) as parent_node_id, any_value(translatable) as translatable from segments group by id),
last as (select * from (select distinct segment_id, record_no, source_hash, translated_text, status, attempt, metadata, glossary_sha256 from translations)
  qualify row_number() over (partition by segment_id order by record_no desc) = 1),
pairs as (select s.id as segment_id, s.kind, coalesce(s.source_text, '') as source_text, coalesce(l.translated_text, '') as target
  from seg s join last l on l.segment_id = s.id and l.source_hash = s.source_hash where l.status = 'completed')"""
_n = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_FN, _URL, _FO, _CO = r"\[\^[^\]]+\]", r"https?://\S+", r"\$\s*\^\{?\d+\}?\s*\$", "<!--.*?-->"
_ST = "|".join([_FN, _CO, _URL, _FO])
_CITE = lambda c: f"({_n(c, r'\([^)]*\b(?:19|20)[0-9][0-9]\b[^)]*\)')} + {_n(c, r'\[\d+(?:[,;]\s*\d+)*\]')})"
_YEARS = lambda c: f"len(list_filter(regexp_extract_all({c}, '\\d+'), lambda x: regexp_full_match(x, '(19|20)\\d\\d')))"
_ROM = lambda c: f"len(list_filter(regexp_extract_all({c}, '[A-Za-z]+'), lambda x: regexp_full_match(x, 'M{{0,3}}(CM|CD|D?C{{0,3}})(XC|XL|L?X{{0,3}})(IX|IV|V?I{{0,3}})')))"
_PER = {
    "sn": _n("source_text", _FN), "tn": _n("target", _FN), "su": _n("source_text", _URL), "tu": _n("target", _URL), "sf": _n("source_text", _FO), "tf": _n("target", _FO),
    "ss": _n("source_text", _ST), "ts": _n("target", _ST), "sc": _CITE("source_text"), "tc": _CITE("target"), "sy": _YEARS("source_text"), "ty": _YEARS("target"),
    "sm": _n("source_text", r"\d+(?:[.,]\d+)*"), "tm": _n("target", r"\d+(?:[.,]\d+)*"), "sp": _n("source_text", r"\d+(?:\.\d+)?\s*%"), "tp": _n("target", r"\d+(?:\.\d+)?\s*%"),
    "sr": _ROM("source_text"), "tr": _ROM("target"), "sb": _n("source_text", r"\|"), "tb": _n("target", r"\|"),
    "sl": r"list_distinct(list_transform(regexp_extract_all(source_text, 'https?://\S+'), lambda x: regexp_replace(x, '[.,;:!?。；！？、，]+$', '')))",
    "tl": r"list_distinct(list_transform(regexp_extract_all(target, 'https?://\S+'), lambda x: regexp_replace(regexp_replace(x, '[.,;:!?。；！？、，]+$', ''), '[　-鿿가-퟿豈-﫿＀-￯].*$', '')))",
}


def _parity_sql(pairs: str) -> str:
    counted = f"counted as (select segment_id, kind, {', '.join(f'{v} as {k}' for k, v in _PER.items())} from {pairs})"
    fam = "case when sn <> tn then 'footnotes' when su <> tu then 'urls' when sf <> tf then 'formulas' else 'structural' end"
    rest = " union all ".join(
        f"select segment_id, '{n}', {a}, {b} from counted where {w}"
        for n, a, b, w in (
            ("urls", "su", "tu", f"(len(list_filter(sl, lambda x: not list_contains(tl, x))) > 0 or len(list_filter(tl, lambda x: not list_contains(sl, x))) > 0) and not (ss <> ts and {fam} = 'urls')"),
            ("footnotes", "sn", "tn", f"sn <> tn and not (ss <> ts and {fam} = 'footnotes')"),
            ("formulas", "sf", "tf", f"sf <> tf and not (ss <> ts and {fam} = 'formulas')"),
            ("citation_markers", "sc", "tc", "sc <> tc"), ("years", "sy", "ty", "sy <> ty"), ("numerals", "sm", "tm", "sm <> tm"), ("percentages", "sp", "tp", "sp <> tp"),
            ("roman_numerals", "sr", "tr", "sr <> tr"), ("table_delimiters", "sb", "tb", "kind = 'table' and sb <> tb"),
        )
    )
    return f"""{counted},
parity as (select segment_id, 'qa-1' as stage, c as "check", case when c in ('structural','footnotes','urls','formulas','table_delimiters') then 'high' else 'flag' end as severity,
  cast(e as integer) as expected, cast(a as integer) as actual from (
  select segment_id, {fam} as c, ss as e, ts as a from counted where ss <> ts union all {rest}))"""


_BARE = "regexp_replace(target, '[\\s\\x{3000}\\x{00a0}]+', '', 'g')"
_SQ = lambda c: f"trim(regexp_replace({c}, '[\\s\\x{{00a0}}]+', ' ', 'g'))"
_RES = f"""tokens as (select segment_id, unnest(t) as token, generate_subscripts(t, 1) as i from (select segment_id, string_split({_SQ('target')}, ' ') as t from pairs)),
isl as (select *, regexp_full_match(token, '[A-Za-z]+(?:[''’\\-][A-Za-z]+)*') as ok, i - row_number() over (partition by segment_id, regexp_full_match(token, '[A-Za-z]+(?:[''’\\-][A-Za-z]+)*') order by i) as g from tokens),
runs as (select segment_id, cast(max(case when ok then n else 0 end) as integer) as run from (select segment_id, ok, g, count(*) as n from isl group by all) group by segment_id)"""
_STARTERS = ", ".join(f"'{w}'" for w in tx.SENTENCE_STARTERS)
_NOUN = f"""words as (select segment_id, target, regexp_replace(w, '[^A-Za-zÀ-ÖØ-öø-ÿ’''\\-]+$', '') as w, i from (
  select segment_id, target, unnest(t) as w, generate_subscripts(t, 1) as i from (select segment_id, target, string_split({_SQ('source_text')}, ' ') as t from pairs))),
named as (select *, regexp_full_match(w, '[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ’''\\-]+') and w not in ({_STARTERS}) as ok from words),
isles as (select *, i - row_number() over (partition by segment_id, ok order by i) as g from named),
spans as (select segment_id, any_value(target) as target, string_agg(w, ' ' order by i) as span, list(w order by i) as ws from isles where ok group by segment_id, g having count(*) >= 2),
lost as (select distinct segment_id, span from spans where not contains(target, span)
  and not list_bool_or(list_transform(range(1, len(ws)), lambda k: contains(target, ws[k] || ' ' || ws[k + 1]))))"""
_REP = f"""sent as (select segment_id, lower({_SQ('s')}) as sentence from (select segment_id, unnest(regexp_split_to_array(target, '[。！？!?；;]+')) as s from pairs)),
rep as (select segment_id, sentence from sent where length(sentence) >= 4 group by 1, 2 having count(*) >= 3)"""
_ALL = f"""with {_BASE}, {_parity_sql('pairs')}, {_RES}, {_NOUN}, {_REP},
dup as (select segment_id, n from (select segment_id, count(*) over (partition by target) as n from pairs where {_BARE} <> '') where n > 2),
full_pairs as (select p.*, r.run, {_BARE} = '' as blank from pairs p left join runs r using (segment_id)),
flags as (
  select * from parity
  union all select segment_id, 'qa-3', 'empty', 'high', 1, 0 from full_pairs where blank
  union all select segment_id, 'qa-3', 'length_ratio', 'flag', 1, 0 from full_pairs where not blank and length(source_text) > 0 and length(target) / length(source_text) < 0.5
  union all select segment_id, 'qa-3', 'short', 'flag', 1, 0 from full_pairs where not blank and length(target) < 8 and length(source_text) > 64
  union all select segment_id, 'qa-3', 'residual', 'flag', 1, 0 from full_pairs where not blank and run > 8
  union all select distinct l.segment_id, 'qa-3', 'proper_noun', 'flag', 1, 0 from lost l join full_pairs f using (segment_id) where not blank
  union all select distinct segment_id, 'qa-3', 'repeated_sentence', 'flag', 1, 0 from rep
  union all select segment_id, 'qa-3', 'duplicate', 'flag', 1, cast(n as integer) from dup
  union all select segment_id, 'qa-3', 'footnote_missing', 'high', cast(sn as integer), cast(tn as integer) from counted where sn > tn and segment_id not in (select segment_id from parity))"""
_TRIAGE = _ALL + """, decided as (select f.segment_id, f.stage, f."check", case
  when stage = 'qa-1' and f."check" = 'urls' and len(list_filter(c.sl, lambda x: not list_contains(c.tl, x))) = 0 then 'auto_pass'
  when (stage = 'qa-1' and f."check" in ('years','numerals','roman_numerals','percentages') and trim(target) <> '' and regexp_matches(target, '[〇一二三四五六七八九十百千万亿零年月卷部分0-9]'))
    or (f."check" = 'citation_markers' and note and han and (contains(target, '年') or paren))
    or (f."check" = 'length_ratio' and han and length(target) / greatest(length(source_text), 1) >= 0.12)
    or (f."check" = 'proper_noun' and han and (note or paren or length(source_text) < 80))
    or (f."check" = 'duplicate' and (length(target) <= 40 or regexp_matches(lower(source_text), 'further reading|conclusions|references|bibliography')))
    or (f."check" = 'residual' and note and han and paren) then 'auto_acceptable_variant' else 'needs_human' end as decision
  from flags f join counted c using (segment_id) join (select *, kind in ('footnote','caption') as note, regexp_matches(target, '[\\x{3400}-\\x{9fff}]') as han,
    contains(target, '(') or contains(target, '（') as paren from pairs) p using (segment_id))"""
_PRIORITY = "case \"check\" " + " ".join(f"when '{k}' then {v}" for k, v in audit.PRIORITY.items()) + " else 50 end"
_ORD = "partition by parent_node_id order by page_json nulls first, id"
ORACLE = {
    "qa_flags_long": _ALL + ' select segment_id, stage, "check", severity, expected, actual from flags',
    "qa_flags_by_check": _ALL + ' select stage, "check", count(*) as flags, count(distinct segment_id) as segments from flags group by 1, 2',
    "qa_planted_parity": f"with planted as (select distinct id as segment_id, kind, coalesce(source_text, '') as source_text, coalesce(translated_text, '') as target from qa_planted_errors), {_parity_sql('planted')} select * from parity",
    "duplicate_targets": f"with {_BASE} select segment_id, cast(n as integer) as actual from (select segment_id, count(*) over (partition by target) as n from pairs where {_BARE} <> '') where n > 2",
    "repeated_sentences": f"with {_BASE}, {_REP} select segment_id, sentence from rep",
    "residual_runs": f"with {_BASE}, {_RES} select segment_id, run from runs",
    "proper_nouns": f"with {_BASE}, {_NOUN} select segment_id, span from lost",
    "triage_decisions": _TRIAGE + ' select stage, "check", decision, count(*) as flags from decided group by 1, 2, 3',
    "triage_queue": _TRIAGE + f""" select segment_id, checks, priority, cast(row_number() over (order by priority desc, segment_id) as integer) as place from (
  select segment_id, list_sort(list(distinct "check")) as checks, max({_PRIORITY}) as priority from decided where decision = 'needs_human' group by 1) order by priority desc, segment_id limit 20""",
    "lww_compaction": f"with {_BASE} select segment_id, record_no, status, attempt, source_hash from last",
    "pending_work": f"with {_BASE} select id, book_id from seg s where translatable and not exists (select 1 from last l where l.segment_id = s.id and l.source_hash = s.source_hash and l.status = 'completed')",
    "unknown_rows": f"with {_BASE} select segment_id, record_no from last l where status = 'completed' and not exists (select 1 from seg s where s.id = l.segment_id)",
    "coverage_classes": f"with {_BASE} select s.id, case when l.segment_id is null then 'missing' when l.status = 'completed' and l.source_hash = s.source_hash then 'current' else 'stale' end as coverage from seg s left join last l on l.segment_id = s.id",
    "coverage": f"""with {_BASE}, c as (select count(*) as n, count(*) filter (where l.status = 'completed' and l.source_hash = s.source_hash) as k from seg s left join last l on l.segment_id = s.id where translatable)
select n as required, k as completed, round(case when n = 0 then 1.0 else k / n end, 6) as coverage, n = k as ready from c""",
    "target_prefix": f"""with {_BASE} select id, cast(row_number() over (order by id) as integer) as place from seg s where translatable
  and not exists (select 1 from last l where l.segment_id = s.id and l.source_hash = s.source_hash and l.status = 'completed')""",
    "currency_invalidation": f"""with {_BASE}, rows as (select l.*, s.book_id, s.source_hash as now from last l join seg s on s.id = l.segment_id),
v as (select book_id, arg_max(glossary_sha256, record_no) as version from rows where glossary_sha256 is not null group by 1)
select segment_id, coalesce(status = 'completed' and source_hash = now and metadata.prompt_version = '2' and metadata.context_mode = 'contextual' and (glossary_sha256 is null or glossary_sha256 = v.version), false) as is_current from rows left join v using (book_id)""",
    "context_windows": f"""with {_BASE} select id, coalesce(list(source_text) over (w rows between 2 preceding and 1 preceding), []) as previous,
  coalesce(list(source_text) over (w rows between 1 following and 2 following), []) as following from seg where source_text is not null and parent_node_id is not null window w as ({_ORD})""",
    "previous_tail": f"""with {_BASE}, r as (select s.id, parent_node_id, page_json, l.translated_text from seg s left join last l on l.segment_id = s.id and l.source_hash = s.source_hash and l.status = 'completed' where parent_node_id is not null),
t as (select id, last_value(translated_text ignore nulls) over ({_ORD} rows between unbounded preceding and 1 preceding) as t from r)
select id, case when t is null or regexp_matches(regexp_replace(t, '[\\s\\x{{3000}}]+$', ''), '[.!?。！？…][”»“"’'')）]*$') then '' else right(regexp_replace(t, '[\\s\\x{{3000}}]+$', ''), 300) end as tail from t""",
}
