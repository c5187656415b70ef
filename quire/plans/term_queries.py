"""Queries on terminology and telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import telemetry, terms
from quire.runtime import table


def _segments(spark, d):
    return table(spark, d, "segments").select("id", "book_id", "kind", "source_text").distinct()


def _candidates(spark, d):
    return table(spark, d, "term_candidates").select("candidate_id", "book_id", "surface", "variants", "source_type", "occurrences", "evidence_segment_ids", "score").dropDuplicates(["candidate_id"])


def _surfaces(spark, d):
    return _candidates(spark, d).where("surface is not null").select(tx.term_normal(F.col("surface")).alias("term")).where("term <> ''").distinct()


def term_ngrams(spark, d):
    """Repeated n-grams of all segments."""
    return terms.ngrams(_segments(spark, d))


def term_mining(spark, d):
    """Candidates of all signals."""
    return terms.mine(_segments(spark, d))


def term_queue(spark, d):
    """The first eighty candidates."""
    return terms.candidate_queue(terms.mine(_segments(spark, d)))


def term_matches(spark, d):
    """Segments per mined term."""
    return terms.matches(_surfaces(spark, d), _segments(spark, d)).groupBy("term").agg(F.count("*").alias("segments"))


def term_normals(spark, d):
    """Normal forms of surfaces."""
    s = F.col("surface")
    return _candidates(spark, d).where("surface is not null").select("candidate_id", tx.term_normal(s).alias("normal"), tx.join_normal(s).alias("join_normal"))


def master_matches(spark, d):
    """Surfaces against the surfaces with the most occurrences as glossary."""
    c = _candidates(spark, d).where("surface is not null")
    master = c.select(F.col("surface").alias("term"), F.col("candidate_id").alias("ordinal"))
    return terms.master_match(c.select("surface").distinct(), master)


def primary_windows(spark, d):
    """Book with most evidence for each candidate."""
    ev = _candidates(spark, d).select(F.col("candidate_id").alias("candidate"), F.explode("evidence_segment_ids").alias("segment_id"))
    w = _segments(spark, d).select(F.col("id").alias("segment_id"), F.col("book_id").alias("window_id"), F.substring("book_id", 4, 7).try_cast("int").alias("idx"))
    return terms.primary_window(ev, w)


def known_term_recall(spark, d):
    """How far the surfaces come through mining, queue and evidence."""
    c = _candidates(spark, d).where("surface is not null")
    return terms.known_recall(c.select("surface").distinct(), c.where("occurrences >= 2").select("surface"), c.where("score >= 10").select("surface"), c.where("size(evidence_segment_ids) > 2").select("surface"))


def concepts(spark, d):
    """Candidates merged into concepts."""
    return terms.compile_concepts(_candidates(spark, d))


def shared_surfaces(spark, d):
    """Normal forms of several books."""
    return terms.shared_surfaces(_candidates(spark, d))


def mining_metrics(spark, d):
    """Rates over candidates and segments."""
    return terms.mining_metrics(_candidates(spark, d), _segments(spark, d))


def source_type_counts(spark, d):
    """Candidates by source type."""
    return terms.source_type_counts(_candidates(spark, d))


def review_ranks(spark, d):
    """Candidates a reader should see."""
    return terms.review_rank(_candidates(spark, d))


def usage_totals(spark, d):
    """Events as usage rows: totals per type, requests from the JSON column."""
    e = table(spark, d, "events").select("event_type", F.col("user_id").alias("key"), "value", (F.col("event_type") == "error").alias("failed"), F.get_json_object("props", "$.k").try_cast("long").alias("requests"))
    return telemetry.usage_totals(e, ["event_type"])


def message_delta(spark, d):
    """Event types per user that grew from the first half of the ids to the second."""
    e = table(spark, d, "events").select("event_id", "event_type", "user_id")
    return telemetry.message_delta(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["event_type", "user_id"])


QUERIES = {
    f.__name__: f
    for f in (
        term_ngrams, term_mining, term_queue, term_matches, term_normals, master_matches, primary_windows, known_term_recall, concepts, shared_surfaces, mining_metrics, source_type_counts, review_ranks,
        usage_totals, message_delta,
    )
}

_S = "s as (select distinct id, book_id, kind, source_text from segments)"
_C = "c as (select distinct candidate_id, book_id, surface, variants, source_type, occurrences, evidence_segment_ids, score from term_candidates)"
_W = "[A-Za-zÀ-ÖØ-öø-ÿĀ-ž][A-Za-zÀ-ÖØ-öø-ÿĀ-ž’''\\-]{2,}"
_STOP = ", ".join(f"'{w}'" for w in terms.STOPWORDS)
_TN = lambda c: f"trim(regexp_replace(translate(lower({c}), '–—', '--'), '[^\\pL\\pN_]+', ' ', 'g'))"
_JN = lambda c: f"array_to_string(list_filter(string_split({_TN(c)}, ' '), lambda x: length(x) > 2), ' ')"
ORACLE = {
    "term_ngrams": f"""with {_S}, t as (select id, regexp_extract_all(lower(source_text), '{_W}') as t from s where source_text is not null),
g as (select id, unnest(list_transform(range(1, len(t)), lambda i: t[i:i + 1])) as g from t union all select id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i:i + 2])) as g from t)
select array_to_string(g, ' ') as phrase, count(*) as n, count(distinct id) as segments from g where g[1] not in ({_STOP}) and g[-1] not in ({_STOP}) group by 1 having count(*) >= 4""",
    "term_normals": f"with {_C} select candidate_id, {_TN('surface')} as normal, {_JN('surface')} as join_normal from c where surface is not null",
    "master_matches": f"""with {_C}, u as (select distinct surface from c where surface is not null), m as (select surface as term, candidate_id as o from c where surface is not null),
e as (select {_TN('term')} as k, arg_min(term, o) as x from m group by 1 having k <> ''), l as (select {_JN('term')} as k, arg_min(term, o) as y from m group by 1 having k <> '')
select surface, coalesce(x, y) as entry, case when x is not null then 'exact' when y is not null then 'loose' end as how from u left join e on e.k = {_TN('surface')} left join l on l.k = {_JN('surface')}""",
    "primary_windows": f"""with {_C}, {_S}, ev as (select candidate_id as candidate, unnest(evidence_segment_ids) as segment_id from c),
per as (select candidate, book_id, try_cast(substring(book_id, 4, 7) as integer) as idx, count(distinct segment_id) as hits from ev join s on s.id = segment_id group by 1, 2, 3)
select candidate, book_id as window_id, hits from per qualify row_number() over (partition by candidate order by hits desc, idx, book_id desc) = 1""",
    "known_term_recall": f"""with {_C}, k as (select distinct surface, {_TN('surface')} as k from c where surface is not null), f as (select {_TN('surface')} as k, bool_or(occurrences >= 2) as m, bool_or(score >= 10) as q, bool_or(len(evidence_segment_ids) > 2) as r from c where surface is not null group by 1)
select surface, case when not coalesce(m, false) then 'lost_mining' when not coalesce(q, false) then 'lost_queue' when not coalesce(r, false) then 'lost_retention' else 'retained' end as stage from k join f using (k)""",
    "concepts": f"""with {_C}, n as (select {_TN('surface')} as norm, surface, evidence_segment_ids as e from c where surface is not null)
select 'concept-' || left(sha256(norm), 12) as concept_id, min(surface) as canonical, list_sort(list(distinct surface)) as surfaces, cast(len(list_distinct(flatten(list(e)))) as integer) as evidence from n where norm <> '' group by norm""",
    "shared_surfaces": f"with {_C} select {_TN('surface')} as norm, count(distinct book_id) as books from c where surface is not null group by 1 having count(distinct book_id) > 1",
    "mining_metrics": f"""with {_C}, {_S} select count(*) as candidates, (select count(distinct id) from s) as segments, round(count(*) / (select count(distinct id) from s), 4) as per_segment,
  round(count(*) filter (where contains(surface, ' ')) / count(*), 4) as multiword_share, round(count(*) filter (where len(list_distinct(evidence_segment_ids)) = 1) / count(*), 4) as single_evidence_share from c""",
    "source_type_counts": f"with {_C} select source_type, count(*) as candidates, cast(coalesce(sum(occurrences), 0) as bigint) as occurrences, cast(sum(coalesce(len(evidence_segment_ids), 0)) as bigint) as evidence from c group by 1",
    "review_ranks": f"with {_C} select * from (select candidate_id, case when coalesce(score, 0) < 0.5 then 1 when coalesce(len(variants), 0) > 1 then 2 when coalesce(len(evidence_segment_ids), 0) = 0 then 3 end as rank from c) where rank is not null",
    "usage_totals": """select event_type, count(*) as rows, count(distinct user_id) as keys, round(sum(value), 4) as total, count(*) filter (where event_type = 'error') as failed,
  cast(sum(coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 1)) as bigint) as requests, round(greatest(sum(coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 1)) - count(*), 0) / nullif(sum(coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 1)), 0), 6) as retry_rate from events group by 1""",
    "message_delta": """with a as (select event_type, user_id, count(*) as n from events where event_id % 2 = 1 group by all), b as (select event_type, user_id, count(*) as n from events where event_id % 2 = 0 group by all)
select event_type, user_id, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) as fresh from a full join b using (event_type, user_id) where coalesce(a.n, 0) > coalesce(b.n, 0)""",
}
