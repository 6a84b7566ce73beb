"""Queries on classification, duplication, weights, sampling and agreement, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from apothecary.functions import names as N
from apothecary.functions.text import is_blank
from apothecary.operators import classify, components, modeling, ranges
from apothecary.session import spread
from apothecary.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# Classification


def _sql_scores(text: str) -> str:
    plain = f"coalesce(trim(replace({text}, chr(13), '')), '')"
    cols = []
    for c in classify.PRIORITY:
        hits = " + ".join(f"case when regexp_matches({plain}, '(?i){p}') then {w} else 0.0 end" for d, _, w, p in classify.RULES if d == c)
        cols.append(f"round(({hits})::double, 3) as {c}")
    return ", ".join(cols)


def _sql_classified(source: str, text: str, keep: str) -> str:
    entry = lambda i, c: f"{{'s': {c}, 'r': {-i}, 'c': '{c}', 'w': {max(w for d, _, w, _ in classify.RULES if d == c)}}}"
    entries = ", ".join(entry(i, c) for i, c in enumerate(classify.PRIORITY))
    return f"""scored as (select {keep}, {_sql_scores(text)} from {source}),
listed as (select {keep}, list_filter([{entries}], lambda x: x.s > 0) as m from scored),
topped as (select {keep}, m, list_max(m) as t from listed),
rested as (select {keep}, m, t, list_max(list_transform(list_filter(m, lambda x: x.c <> t.c), lambda x: x.s)) as o from topped),
classified as (select {keep}, m, coalesce(t.c, 'unknown') as cause, coalesce(round(least(1.0::double, t.s) * t.s / (t.s + coalesce(o, 0.0::double)), 3), 0.0::double) as confidence_score,
  case when len(m) = 0 then 'low' when t.s < 1.0 or round(least(1.0::double, t.s) * t.s / (t.s + coalesce(o, 0.0::double)), 3) < 0.60 then 'low' when len(m) > 1 then 'medium' else 'high' end as confidence,
  coalesce(array_to_string(list_transform(m, lambda x: x.c), '|'), '') as matched from rested)"""


@query(f"with {_sql_classified('recalls', 'reason_for_recall', 'row_id')} select row_id, cause, confidence_score, confidence, matched from classified")
def rule_classify(spark, d):
    rows = spread(table(spark, d, "recalls").select("row_id", "reason_for_recall"))
    return classify.classify(rows, F.col("reason_for_recall")).select("row_id", "cause", "confidence_score", "confidence", "matched")


@query(f"""with src as (select candidate_id, raw_text, event.primary_cause as label from phase12_examples), {_sql_classified('src', 'raw_text', 'candidate_id, label')}
select label, cause, count(*) as n from classified group by 1, 2""")
def classifier_confusion(spark, d):
    rows = spread(table(spark, d, "phase12_examples").select("raw_text", F.col("event.primary_cause").alias("label")))
    return classify.classify(rows, F.col("raw_text")).groupBy("label", "cause").agg(F.count(F.lit(1)).alias("n"))


#: A reason with the name of its label: where the two speak of different categories, they meet.
_TOLD = "select distinct candidate_id, concat_ws(' ', raw_text, replace(event.primary_cause, '_', ' ')) as told from phase12_examples"
_MET = """p as (select *, list_transform(m, lambda x: x.c) as c from classified where len(m) > 1), pairs as (select candidate_id, told, c[i] as a, c[j] as b from (select *, unnest(range(i + 1, len(c) + 1)) as j from (select *, unnest(range(1, len(c))) as i from p)))"""


def _met(spark, d) -> DataFrame:
    rows = table(spark, d, "phase12_examples").select("candidate_id", F.concat_ws(" ", "raw_text", F.replace("event.primary_cause", F.lit("_"), F.lit(" "))).alias("told")).distinct()
    return classify.classify(spread(rows), F.col("told"))


@query(f"with src as ({_TOLD}), {_sql_classified('src', 'told', 'candidate_id, told')}, {_MET} select a, b, count(*) as n from pairs group by a, b")
def collision_pairs(spark, d):
    return classify.collision_pairs(_met(spark, d))


@query(f"""with src as ({_TOLD}), {_sql_classified('src', 'told', 'candidate_id, told')}, {_MET}
select a, b, told, n from (select *, row_number() over (partition by a, b order by n desc, first) as r from (select a, b, told, count(*) as n, min(candidate_id) as first from pairs group by all)) where r <= 3""")
def collision_examples(spark, d):
    """The three most frequent texts of each pair of categories, the first seen on ties: a report by definition."""
    counts = classify.pairs_of(_met(spark, d), "candidate_id", "told").groupBy("a", "b", "told").agg(F.count(F.lit(1)).alias("n"), F.min("candidate_id").alias("first"))
    w = Window.partitionBy("a", "b").orderBy(F.desc("n"), "first")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 3").select("a", "b", "told", "n")


@query(f"""with src as (select row_id, {N.sql_reason('reason_for_recall')} as text, reason_for_recall from recalls), {_sql_classified('src', 'reason_for_recall', 'row_id, text')}
select text, count(*) as n from classified where cause = 'unknown' group by text order by n desc, min(row_id) limit 15""")
def top_unmatched_texts(spark, d):
    """The fifteen most frequent texts that no rule matches, a report by definition."""
    rows = spread(table(spark, d, "recalls").select("row_id", "reason_for_recall"))
    out = classify.classify(rows, F.col("reason_for_recall")).where(F.col("cause") == "unknown")
    counted = out.groupBy(N.reason_text(F.col("reason_for_recall")).alias("text")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(15).select("text", "n")


# Duplication and weights

_REASON = N.sql_reason("reason_for_recall")


@query(f"with s as (select {_REASON} as text, count(*) as n from recalls group by 1) select cast(sum(n) as bigint) as records, count(*) as texts, count(*) filter (where n > 1) as repeated_texts, cast(sum(n - 1) as bigint) as excess from s")
def duplication_audit(spark, d):
    return modeling.duplication(table(spark, d, "recalls"), N.reason_text(F.col("reason_for_recall")))


_LIMITS = (2, 3, 5, 10, 20, 50, 100)
_CAPS = (1, 2, 3, 5, 10, 20)


@query(f"""with s as (select {_REASON} as text, count(*) as n from recalls group by 1), k as (select unnest({list(_LIMITS)})::bigint as "limit")
select "limit", (select count(*) from s where n >= "limit") as texts, coalesce((select cast(sum(n) as bigint) from s where n >= "limit"), 0) as records from k""")
def duplication_thresholds(spark, d):
    return modeling.thresholds(table(spark, d, "recalls"), N.reason_text(F.col("reason_for_recall")), _LIMITS)


@query(f"""with s as (select {_REASON} as text, count(distinct event_id) as n from recalls group by 1), k as (select unnest({list(_CAPS)})::bigint as cap)
select cap, cast(coalesce(sum(least(cap, n)), 0) as bigint) as records from k cross join s group by cap""")
def cap_sizes(spark, d):
    return modeling.cap_sizes(table(spark, d, "recalls"), N.reason_text(F.col("reason_for_recall")), F.col("event_id"), _CAPS)


_EXAMPLES = "(select distinct candidate_id, incident_id, reason_text_id, event.primary_cause as cause from phase12_examples)"


def _examples(spark, d) -> DataFrame:
    return table(spark, d, "phase12_examples").select("candidate_id", "incident_id", "reason_text_id", F.col("event.primary_cause").alias("cause")).distinct()


@query(f"""with e as {_EXAMPLES}, p as (select incident_id, reason_text_id, count(*) as filings from e group by all), t as (select reason_text_id, count(*) as incidents from p group by all)
select candidate_id, filings, incidents, 1.0::double / (filings * incidents) as weight from e join p on e.incident_id is not distinct from p.incident_id and e.reason_text_id is not distinct from p.reason_text_id
join t on e.reason_text_id is not distinct from t.reason_text_id""")
def sample_weights(spark, d):
    return modeling.weights(_examples(spark, d), "candidate_id", "incident_id", "reason_text_id")


@query(f"""with e as {_EXAMPLES}, one as (select incident_id, reason_text_id, arg_min(candidate_id, {{'k': sha256(candidate_id), 'r': candidate_id}}) as candidate_id from e where incident_id is not null and reason_text_id is not null group by all)
select candidate_id, incident_id, reason_text_id from (select *, row_number() over (partition by reason_text_id order by sha256(incident_id), incident_id) as n from one) where n <= 5""")
def cap_examples(spark, d):
    rows = _examples(spark, d).where(F.col("incident_id").isNotNull() & F.col("reason_text_id").isNotNull())
    return modeling.capped(rows, "candidate_id", "incident_id", "reason_text_id", 5).select("candidate_id", "incident_id", "reason_text_id")


@query(f"""select cause as label, count(*) as records, count(distinct incident_id) as incidents, count(distinct reason_text_id) as texts,
count(distinct incident_id) >= 3 and count(distinct reason_text_id) >= 3 as sufficient from {_EXAMPLES} group by cause""")
def category_support(spark, d):
    return modeling.support(_examples(spark, d), F.col("cause"), "incident_id", "reason_text_id")


@query(f"with e as {_EXAMPLES}, t as (select candidate_id, cause, case when cause in ('unknown', 'recall') then 1 else 3 end as k from e) select candidate_id, cause, cast(unnest(range(1, k + 1)) as int) as copy from t")
def class_oversample(spark, d):
    times = F.when(F.col("cause").isin("unknown", "recall"), 1).otherwise(3)
    return modeling.oversample(_examples(spark, d), times).select("candidate_id", "cause", "copy")


@query(f"""with e as {_EXAMPLES}, q as (select cause, count(*) as n, round_even(count(*) * 0.4, 0) as quota from e group by cause)
select candidate_id, cause from (select candidate_id, cause, quota, row_number() over (partition by cause order by sha256('seed|' || candidate_id), candidate_id) as r from e join q using (cause)) where r <= quota""")
def stratified_sample(spark, d):
    rows = _examples(spark, d)
    quota = rows.groupBy("cause").agg(F.bround(F.count(F.lit(1)) * 0.4, 0).alias("quota"))
    return modeling.ranked_sample(rows.join(quota, "cause"), "cause", "candidate_id", F.col("quota")).select("candidate_id", "cause")


@query(f"""with e as (select distinct candidate_id, event.primary_cause as cause from phase12_examples), n as (select *, row_number() over (partition by cause order by sha256('seed|' || candidate_id), candidate_id) as r, count(*) over (partition by cause) as n from e)
select candidate_id, cause, case when r <= v then 'validation' when r <= v + t then 'test' else 'train' end as split from (select *, case when n >= 3 then greatest(1, round_even(n * 0.15, 0)) else 0 end as v, case when n >= 3 then greatest(1, round_even(n * 0.15, 0)) else 0 end as t from n)""")
def stratified_split(spark, d):
    rows = table(spark, d, "phase12_examples").select("candidate_id", F.col("event.primary_cause").alias("cause")).distinct()
    sizes = rows.groupBy("cause").agg(F.count(F.lit(1)).alias("n"))
    part = F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.bround(F.col("n") * 0.15, 0))).otherwise(0)
    ranked = ranges.by_hash(rows.join(sizes, "cause"), ["cause"], modeling.seeded("candidate_id"), "candidate_id", "r").withColumn("part", part)
    split = F.when(F.col("r") <= F.col("part"), "validation").when(F.col("r") <= 2 * F.col("part"), "test").otherwise("train")
    return ranked.select("candidate_id", "cause", split.alias("split"))


# Records of several sources

#: What ties records that must not be parted between training and evaluation.
_LEAKS = ("incident_id", "reason_text_id")
_POOL = "(select distinct candidate_id, split, source, incident_id, reason_text_id, annotation_origin, event.primary_cause as cause, sample_weight from phase11_examples)"


def _pool(spark, d) -> DataFrame:
    return table(spark, d, "phase11_examples").select("candidate_id", "split", "source", "incident_id", "reason_text_id", "annotation_origin", F.col("event.primary_cause").alias("cause"), "sample_weight").distinct()


@query(f"select split, count(*) as records, round(sum(sample_weight), 6) as weight, count(distinct incident_id) as incidents, count(distinct reason_text_id) as texts from {_POOL} group by split")
def split_metrics(spark, d):
    return _pool(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.round(F.sum("sample_weight"), 6).alias("weight"), F.countDistinct("incident_id").alias("incidents"), F.countDistinct("reason_text_id").alias("texts"))


@query(f"select count(*) as shared from (select reason_text_id from {_POOL} where split = 'train' and reason_text_id is not null intersect select reason_text_id from {_POOL} where split in ('validation', 'test', 'gold_evaluation'))")
def leakage_checks(spark, d):
    rows = _pool(spark, d)
    train = rows.where("split = 'train' and reason_text_id is not null").select("reason_text_id")
    return train.intersect(rows.where(F.col("split").isin("validation", "test", "gold_evaluation")).select("reason_text_id")).agg(F.count(F.lit(1)).alias("shared"))


@query(f"""with recursive p as {_POOL}, e as (select distinct candidate_id as node, x as entity from (select candidate_id, unnest([nullif('i:' || lower(regexp_replace(incident_id, '\\s', '', 'g')), 'i:'), nullif('t:' || lower(regexp_replace(reason_text_id, '\\s', '', 'g')), 't:')]) as x from p) where x is not null),
tied(node) as (select candidate_id from p where split = 'gold_evaluation' union select b.node from tied t join e a on a.node = t.node join e b on b.entity = a.entity)
select candidate_id from p where split <> 'gold_evaluation' and trim(incident_id) <> '' and trim(reason_text_id) <> '' and candidate_id not in (select node from tied)""")
def quarantine_gold_connected(spark, d):
    """Records that no chain of incidents and texts ties to a gold record; records without either id are kept out."""
    rows = _pool(spark, d)
    sets = components.components(components.ties(rows, "candidate_id", _LEAKS))
    node = components.record_node(rows.select("candidate_id", *_LEAKS), "candidate_id")
    tied = rows.withColumn("node", node).join(sets, "node")
    gold = tied.where("split = 'gold_evaluation'").select("label").distinct()
    rest = tied.where((F.col("split") != "gold_evaluation") & ~is_blank(F.col("incident_id")) & ~is_blank(F.col("reason_text_id")))
    return rest.join(gold, "label", "left_anti").select("candidate_id")


@query("""with l as (select reason_text_id, arg_min(event.primary_cause, {'s': snapshot, 'c': event.primary_cause}) as cause from phase11_examples where annotation_origin = 'gold' and event.primary_cause is not null and reason_text_id is not null group by 1),
p as (select distinct candidate_id, reason_text_id, event.primary_cause as guess, source from phase11_examples where annotation_origin <> 'gold')
select source as "by", count(*) as records, count(*) filter (where guess is not distinct from cause) as correct, round(100.0 * count(*) filter (where guess is not distinct from cause) / count(*), 4) as pct from p join l using (reason_text_id) group by source""")
def prediction_compare(spark, d):
    """Labels of teachers against the gold label of the same text."""
    rows = table(spark, d, "phase11_examples").withColumn("cause", F.col("event.primary_cause"))
    gold = F.col("annotation_origin") == "gold"
    labels = rows.where(gold & F.col("cause").isNotNull() & F.col("reason_text_id").isNotNull()).groupBy("reason_text_id").agg(F.min_by("cause", F.struct("snapshot", "cause")).alias("cause"))
    guesses = rows.where(~gold).select("candidate_id", "reason_text_id", F.col("cause").alias("guess"), "source").distinct()
    return modeling.agreement(guesses.join(labels, "reason_text_id"), F.col("cause"), F.col("guess"), F.col("source"))


@query(f"""with src as (select candidate_id, raw_text, event.primary_cause as label from phase12_examples), {_sql_classified('src', 'raw_text', 'candidate_id, label')}
select label as "by", count(*) as records, count(*) filter (where label is not distinct from cause) as correct, round(100.0 * count(*) filter (where label is not distinct from cause) / count(*), 4) as pct from classified group by label""")
def evaluation_by_category(spark, d):
    rows = spread(table(spark, d, "phase12_examples").select("raw_text", F.col("event.primary_cause").alias("label")))
    return modeling.agreement(classify.classify(rows, F.col("raw_text")), F.col("label"), F.col("cause"), F.col("label"))


@query("""select event_type as "by", count(value) as n, round(avg(value), 6) as mean, round(median(value), 6) as median,
list_sort(list(value))[cast(least(count(value) - 1, floor(count(value) * 0.95)) as bigint) + 1] as p95 from events where value is not null group by 1""")
def latency_stats(spark, d):
    return modeling.nearest_rank(table(spark, d, "events").withColumnRenamed("event_type", "by"), "by", "value")


@query("""with c as (select candidate_id, raw_text, coalesce(event.evidence, []) as evidence from phase12_examples where raw_text is not null)
select distinct candidate_id, len(list_filter(evidence, lambda e: e is null or not contains(raw_text, e))) = 0 as valid from c""")
def evidence_validation(spark, d):
    rows = table(spark, d, "phase12_examples").where(F.col("raw_text").isNotNull())
    held = F.forall(F.coalesce("event.evidence", F.array().cast("array<string>")), lambda e: F.coalesce(F.contains(F.col("raw_text"), e), F.lit(False)))
    return rows.select("candidate_id", held.alias("valid")).distinct()


@query(f"""with p as {_POOL}, held as (select * from p where split = 'validation'), shots as (select * from p where split = 'train')
select s.candidate_id from shots s where not exists (select 1 from held h where h.incident_id = s.incident_id) and not exists (select 1 from held h where h.reason_text_id = s.reason_text_id)""")
def fewshot_leakage_filter(spark, d):
    rows = _pool(spark, d)
    held = rows.where("split = 'validation'")
    out = rows.where("split = 'train'").join(held.select("incident_id").distinct(), "incident_id", "left_anti")
    return out.join(held.select("reason_text_id").distinct(), "reason_text_id", "left_anti").select("candidate_id")


@query("""select 'only_phase12' as kind, count(*) as n from (select incident_id from phase12_examples except select incident_id from phase11_examples)
union all select 'only_phase11', count(*) from (select incident_id from phase11_examples except select incident_id from phase12_examples)
union all select 'both', count(*) from (select incident_id from phase12_examples intersect select incident_id from phase11_examples)""")
def key_set_ops(spark, d):
    a, b = (table(spark, d, t).select("incident_id") for t in ("phase12_examples", "phase11_examples"))
    n = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n(a.subtract(b), "only_phase12").unionByName(n(b.subtract(a), "only_phase11")).unionByName(n(a.intersect(b), "both"))


@query("""with u as (select reason_text_id, event.primary_cause as cause, candidate_id, case annotation_origin when 'gold' then 1 when 'teacher' then 2 else 3 end as prio from phase11_examples where reason_text_id is not null)
select reason_text_id, arg_min({'c': cause}, {'p': prio, 's': coalesce(candidate_id, ''), 'c': coalesce(cause, '')}).c as cause, count(distinct cause) as causes from u group by 1""")
def priority_merge(spark, d):
    """One label a text where sources disagree: gold before teacher before fixed rules."""
    prio = F.when(F.col("annotation_origin") == "gold", 1).when(F.col("annotation_origin") == "teacher", 2).otherwise(3)
    rows = table(spark, d, "phase11_examples").where(F.col("reason_text_id").isNotNull()).select("reason_text_id", F.col("event.primary_cause").alias("cause"), "candidate_id", prio.alias("prio"))
    order = F.struct("prio", F.coalesce("candidate_id", F.lit("")).alias("s"), F.coalesce("cause", F.lit("")).alias("c"))
    return rows.groupBy("reason_text_id").agg(F.min_by(F.struct("cause"), order).alias("m"), F.countDistinct("cause").alias("causes")).select("reason_text_id", "m.cause", "causes")


@query("""with a as (select distinct candidate_id, taxonomy_version, event.severity as severity, raw_text from phase12_examples)
select 'taxonomy_version' as rule, count(*) as violations from a where taxonomy_version is distinct from 'phase9_v1' union all
select 'severity', count(*) from a where severity is null or severity not in ('low', 'medium', 'high') union all
select 'duplicate_candidate', count(*) from (select candidate_id from a group by 1 having count(*) > 1)""")
def record_violations(spark, d):
    a = table(spark, d, "phase12_examples").select("candidate_id", "taxonomy_version", F.col("event.severity").alias("severity"), "raw_text").distinct()
    return modeling.violations(
        {
            "taxonomy_version": a.where(~F.col("taxonomy_version").eqNullSafe(F.lit("phase9_v1"))),
            "severity": a.where(F.col("severity").isNull() | ~F.col("severity").isin("low", "medium", "high")),
            "duplicate_candidate": a.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
        }
    )


@query("""select source, raw_text, event.primary_cause as cause, min(candidate_id) as first_id, count(distinct candidate_id) as members from phase12_examples where raw_text is not null group by all""")
def review_units(spark, d):
    rows = table(spark, d, "phase12_examples").where(F.col("raw_text").isNotNull())
    return rows.groupBy("source", "raw_text", F.col("event.primary_cause").alias("cause")).agg(F.min("candidate_id").alias("first_id"), F.countDistinct("candidate_id").alias("members"))


@query(f"""with g as (select event_id, {_REASON} as text, recall_number, row_id, status, recalling_firm from recalls where snapshot = (select max(snapshot) from recalls))
select event_id, text, count(*) as filings, arg_min(recalling_firm, row_id) as firm, array_to_string(list_sort(list(distinct coalesce(recall_number, '')))[1:3], '|') as first_numbers from g group by event_id, text""")
def corpus_queue(spark, d):
    """Units of one event and text with their filings; the first three recall numbers by definition of the unit."""
    df = table(spark, d, "recalls")
    rows = df.where(F.col("snapshot") == df.agg(F.max("snapshot")).first()[0]).select("event_id", N.reason_text(F.col("reason_for_recall")).alias("text"), F.coalesce("recall_number", F.lit("")).alias("number"), "row_id", "recalling_firm")
    units = rows.groupBy("event_id", "text").agg(F.count(F.lit(1)).alias("filings"), F.min_by("recalling_firm", "row_id").alias("firm"))
    w = Window.partitionBy("event_id", "text").orderBy("number")
    first = rows.select("event_id", "text", "number").distinct().withColumn("r", F.row_number().over(w)).where("r <= 3")
    first = first.groupBy("event_id", "text").agg(F.array_join(F.array_sort(F.collect_list("number")), "|").alias("first_numbers"))
    same = [units["event_id"].eqNullSafe(first["event_id"]), units["text"] == first["text"]]
    return units.join(first, same).select(units["event_id"], units["text"], "filings", "firm", "first_numbers")


@query("""with recursive e as (select distinct candidate_id as node, x as entity from (select candidate_id, unnest([nullif('i:' || lower(regexp_replace(incident_id, '\\s', '', 'g')), 'i:'), nullif('t:' || lower(regexp_replace(reason_text_id, '\\s', '', 'g')), 't:')]) as x from phase12_examples) where x is not null),
reach(node, other) as (select node, node from e union select r.node, b.node from reach r join e a on a.node = r.other join e b on b.entity = a.entity)
select node as candidate_id, min(other) as component from reach group by node""")
def leakage_components(spark, d):
    """The smallest record each record is tied to, through incidents and texts; components are not gathered anywhere."""
    sets = components.components(components.ties(table(spark, d, "phase12_examples"), "candidate_id", _LEAKS))
    return sets.select(F.col("node").alias("candidate_id"), F.col("label").alias("component"))


@query(f"""with p as (select candidate_id, unnest(source_record_ids) as rid, snapshot, event.primary_cause as cause from phase11_examples where event.primary_cause is not null)
select rid as record_id, arg_max(cause, {{'s': snapshot, 'c': candidate_id}}) as cause, count(distinct candidate_id) as labels from p where rid is not null group by rid""")
def root_cause_priority(spark, d):
    """Per source record the label of its latest candidate: explode, then one combining maximum."""
    rows = table(spark, d, "phase11_examples").select("candidate_id", F.explode("source_record_ids").alias("record_id"), "snapshot", F.col("event.primary_cause").alias("cause"))
    rows = rows.where(F.col("record_id").isNotNull() & F.col("cause").isNotNull())
    return rows.groupBy("record_id").agg(F.max_by("cause", F.struct("snapshot", "candidate_id")).alias("cause"), F.countDistinct("candidate_id").alias("labels"))


@query("""select row_id, case when trim(coalesce(event_id, '')) <> '' then 'recall_event:' || event_id when trim(coalesce(recall_number, '')) <> '' then 'recall_record:' || recall_number
else 'missing:' || substr(sha256(coalesce(product_description, '')), 1, 20) end as incident_id from recalls""")
def incident_identity(spark, d):
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    fallback = F.concat(F.lit("missing:"), N.short_hash(F.coalesce("product_description", F.lit("")), 20))
    own = F.when(filled("event_id"), F.concat(F.lit("recall_event:"), "event_id")).when(filled("recall_number"), F.concat(F.lit("recall_record:"), "recall_number")).otherwise(fallback)
    return table(spark, d, "recalls").select("row_id", own.alias("incident_id"))


@query("""with t as (select distinct candidate_id, raw_text, event.primary_cause as cause from phase12_examples where raw_text is not null)
select raw_text, min(candidate_id) as representative, count(*) as copies, count(distinct cause) as causes from t group by raw_text""")
def exact_text_representatives(spark, d):
    rows = table(spark, d, "phase12_examples").where(F.col("raw_text").isNotNull()).select("candidate_id", "raw_text", F.col("event.primary_cause").alias("cause")).distinct()
    return rows.groupBy("raw_text").agg(F.min("candidate_id").alias("representative"), F.count(F.lit(1)).alias("copies"), F.countDistinct("cause").alias("causes"))


@query("""select candidate_id, row_number() over (order by r > 1, h, candidate_id) as place from (select *, row_number() over (partition by source, cause, raw_text order by h, candidate_id) as r from
(select distinct candidate_id, source, event.primary_cause as cause, raw_text, sha256('order|' || candidate_id) as h from phase12_examples)) order by place limit 200""")
def diverse_queue(spark, d):
    """The first 200 of a review queue, by definition of the queue: first occurrences of each text before repeats."""
    rows = table(spark, d, "phase12_examples").select("candidate_id", "source", F.col("event.primary_cause").alias("cause"), "raw_text", F.sha2(F.concat(F.lit("order|"), "candidate_id"), 256).alias("h")).distinct()
    w = Window.partitionBy("source", "cause", "raw_text").orderBy("h", "candidate_id")
    top = rows.withColumn("again", F.row_number().over(w) > 1).orderBy("again", "h", "candidate_id").limit(200)
    return top.select("candidate_id", F.row_number().over(Window.orderBy("again", "h", "candidate_id")).alias("place"))
