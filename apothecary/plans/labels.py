"""Queries on events, identities, samples and evaluation of labelled records, each with its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.functions import names as N
from apothecary.functions.text import is_blank, strip
from apothecary.operators import classify, components, modeling
from apothecary.plans.modeling import _LEAKS, _sql_classified
from apothecary.session import materialise, spread
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


def _now(t: str) -> str:
    return f"(select * from {t} where snapshot = (select max(snapshot) from {t}))"


def _latest(spark, d, name: str) -> DataFrame:
    df = table(spark, d, name)
    return df.where(F.col("snapshot") == df.agg(F.max("snapshot")).first()[0])


# Events


def _records(spark, d) -> DataFrame:
    recalls = table(spark, d, "recalls").select(F.lit("recalls").alias("feed"), "row_id", F.lit(True).alias("is_recall"), F.col("reason_for_recall").alias("text"), "classification", F.lit(None).cast("string").alias("availability"), "status")
    short = table(spark, d, "shortages").select(F.lit("shortages").alias("feed"), "row_id", F.lit(False).alias("is_recall"), F.col("shortage_reason").alias("text"), F.lit(None).cast("string").alias("classification"), "availability", "status")
    return spread(recalls.unionByName(short))


_SRC = """src as (select 'recalls' as feed, row_id, true as is_recall, reason_for_recall as text, classification, null::varchar as availability, status from recalls
  union all select 'shortages', row_id, false, shortage_reason, null, availability, status from shortages)"""
_STAGE = """case cause when 'active_ingredient_shortage' then 'raw_material_sourcing' when 'inactive_ingredient_shortage' then 'raw_material_sourcing' when 'manufacturing_quality_problem' then 'manufacturing'
  when 'manufacturing_capacity' then 'manufacturing' when 'regulatory_delay' then 'regulatory_review' when 'shipping_delay' then 'distribution' when 'demand_increase' then 'demand_planning'
  when 'product_discontinuation' then 'product_lifecycle' when 'labeling_packaging_error' then 'packaging_labeling' when 'regulatory_noncompliance' then 'regulatory_compliance'
  when 'adverse_event_signal' then 'post_market_surveillance' when 'recall' then 'post_market_action' else 'unknown' end"""
_SEVERITY = """case when is_recall then case lower(trim(coalesce(classification, ''))) when 'class i' then 'high' when 'class iii' then 'low' else 'medium' end
  when lower(trim(coalesce(availability, ''))) = 'unavailable' then 'high' when lower(trim(coalesce(availability, ''))) = 'limited availability' then 'medium'
  when lower(trim(coalesce(status, ''))) = 'resolved' then 'low' else 'medium' end"""


@query(f"""with {_SRC}, {_sql_classified('src', 'text', 'feed, row_id, is_recall, text, classification, availability, status')}
select feed, row_id, cause, confidence, {_STAGE} as stage, {_SEVERITY} as severity, len(m) = 0 as fallback,
  array_to_string(list_concat(list_transform(list_filter(m, lambda x: x.c <> cause), lambda x: 'also_matched:' || x.c), case when is_recall then ['recall_event'] else [] end), '|') as secondary,
  array_to_string(list_filter([case when is_recall then 'FDA reason_for_recall: ' else 'FDA shortage_reason: ' end || case when coalesce({N.sql_strip('text')}, '') = '' then 'not supplied' else {N.sql_strip('text')} end,
    case when classification <> '' then 'FDA classification: ' || classification end, case when status <> '' then 'FDA status: ' || status end, case when availability <> '' then 'FDA availability: ' || availability end], lambda x: x is not null), '|') as evidence from classified""")
def classify_records(spark, d):
    out = classify.events(_records(spark, d))
    return out.select("feed", "row_id", "cause", "confidence", "stage", "severity", "fallback", F.array_join("secondary", "|").alias("secondary"), F.array_join("evidence", "|").alias("evidence"))


@query("""with p as (select unnest(['Shortage of an active ingredient', 'Shortage of an inactive ingredient component', 'Requirements related to complying with good manufacturing practices', 'Demand increase for the drug',
  'Delay in shipping of the drug', 'Regulatory delay', 'Discontinuation of the manufacture of the drug', 'Other']) as phrase, unnest(['active_ingredient_shortage', 'inactive_ingredient_shortage', 'manufacturing_quality_problem',
  'demand_increase', 'shipping_delay', 'regulatory_delay', 'product_discontinuation', 'unknown']) as expected)
select phrase, expected, expected as cause, (select count(*) from shortages where trim(shortage_reason) = phrase) as records from p""")
def phrase_agreement(spark, d):
    """The feed's own phrases: what each stands for, what the rules make of it, and how many shortages give it as reason."""
    phrases = spark.createDataFrame(list(classify.PHRASES.items()), "phrase string, expected string")
    counts = table(spark, d, "shortages").where(F.trim("shortage_reason").isin(list(classify.PHRASES))).groupBy(F.trim("shortage_reason").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))
    return classify.classify(phrases, F.col("phrase")).join(counts, "phrase", "left").select("phrase", "expected", "cause", F.coalesce("n", F.lit(0)).alias("records"))


_FAMILY_SQL = " union all ".join(f"select '{k}' as family, count(*) filter (where regexp_matches(coalesce(reason_for_recall, ''), '(?i){p}')) as records, count(distinct case when regexp_matches(coalesce(reason_for_recall, ''), '(?i){p}') then reason_for_recall end) as texts from recalls" for k, p in (
    ("storage_temperature_excursion", "temperature excursion|storage temperature|temperature abuse|improper storage"), ("counterfeit_or_tampering", "counterfeit|tamper"), ("capacity_context", "production|manufactur|facility|plant|equipment|supply"),
    ("capacity_pressure", "capacity|unable|cannot|could not|delay|shortage|interruption|shutdown|closed|closure|out of business|production issue|equipment failure"), ("pilot_edge", "temperature|delivery system|subpotent|imprint|excipient|shipping|transit|mislab")))


@query(_FAMILY_SQL)
def reason_families(spark, d):
    """Records and texts of each family of reasons, all in one pass."""
    families = classify.GAP_FAMILIES | {"capacity_context": classify.CAPACITY_CONTEXT, "capacity_pressure": classify.CAPACITY_PRESSURE, "pilot_edge": classify.PILOT_EDGE}
    c = F.col("reason_for_recall")
    texts = spread(table(spark, d, "recalls").groupBy("reason_for_recall").agg(F.count(F.lit(1)).alias("n")))
    one = texts.agg(*[F.struct(F.lit(k).alias("family"), F.coalesce(F.sum(F.when(classify.in_family(c, p), F.col("n"))), F.lit(0)).alias("records"), F.count_if(classify.in_family(c, p)).alias("texts")).alias(k) for k, p in families.items()])
    return one.select(F.explode(F.array(*families)).alias("f")).select("f.*")


_EDGE_SQL = (
    ("temperature_abuse", "temperature abuse|temperature excursion"), ("defective_delivery_system", "defective delivery system"), ("subpotent_phrasing", r"\bsubpotent\b|\bsub-potent\b"),
    ("tablet_imprint", "tablet imprint|incorrect imprint|missing imprint"), ("undeclared_excipients", "undeclared excipient|incorrect excipient"),
    ("shipping_quality_collision", "(?:shipping|transit) delay.*temperature|temperature.*(?:shipping|transit) delay"), ("dual_cause_and", r"\b(?:and|additionally|also)\b"),
)


@query(f"""with src as (select distinct candidate_id, raw_text, event.primary_cause as label from phase12_examples), {_sql_classified('src', 'raw_text', 'candidate_id, raw_text, label')},
s as (select 'fallback' as subset, label, cause from classified where len(m) = 0 union all select 'collision', label, cause from classified where len(m) > 1
  {' '.join(f"union all select '{k}', label, cause from classified where regexp_matches(coalesce(raw_text, ''), '(?i){p}')" for k, p in _EDGE_SQL)})
select n.subset, count(s.subset) as records, count(s.subset) filter (where label is not distinct from cause) as agreed, case when count(s.subset) > 0 then round(100.0 * count(s.subset) filter (where label is not distinct from cause) / count(s.subset), 4) end as pct
from (select unnest({['fallback', 'collision', *(k for k, _ in _EDGE_SQL)]}) as subset) n left join s using (subset) group by n.subset""")
def subset_agreement(spark, d):
    """How often rules and labels agree in named subsets; percent is NULL where a subset is empty."""
    rows = spread(table(spark, d, "phase12_examples").select("candidate_id", "raw_text", F.col("event.primary_cause").alias("label")).distinct())
    out = classify.classify(rows, F.col("raw_text"))
    subsets = {"fallback": F.col("matched") == "", "collision": F.size(F.split("matched", r"\|")) > 1} | {k: classify.in_family(F.col("raw_text"), p) for k, p in classify.EDGE_FAMILIES.items()}
    right = F.col("label").eqNullSafe(F.col("cause"))
    one = out.agg(*[F.struct(F.lit(k).alias("subset"), F.count_if(c).alias("records"), F.count_if(c & right).alias("agreed"), F.round(F.try_divide(100.0 * F.count_if(c & right), F.count_if(c)), 4).alias("pct")).alias(k) for k, c in subsets.items()])
    return one.select(F.explode(F.array(*subsets)).alias("s")).select("s.*")


# Identities

_HASH = lambda *c: "substr(sha256(concat_ws(chr(31), " + ", ".join(f"coalesce({x}, '')" for x in c) + ")), 1, 10)"
_SHORT_ID = f"coalesce(package_ndc, 'missing') || ':' || {_HASH('package_ndc', 'initial_posting_date', 'presentation', 'company_name')}"
_RECALL_ID = f"coalesce(nullif(recall_number, ''), 'event-' || coalesce(event_id, 'missing') || '-' || {_HASH('product_description', 'recall_initiation_date')})"
_BLANK = lambda c: f"coalesce({N.sql_strip(c)}, '') = ''"


@query(f"""select 'recalls' as feed, row_id, {_RECALL_ID} as source_id, case when trim(coalesce(event_id, '')) <> '' then 'recall_event:' || trim(event_id) else 'recall_record:' || {_RECALL_ID} end as incident_id from recalls
union all select 'shortages', row_id, {_SHORT_ID}, case when {_BLANK('generic_name')} and {_BLANK('company_name')} and {_BLANK('initial_posting_date')} then 'shortage_record:' || {_SHORT_ID}
  else 'shortage_event:' || sha256({N.sql_reason('generic_name')} || chr(31) || {N.sql_reason('company_name')} || chr(31) || {N.sql_reason('initial_posting_date')}) end from shortages""")
def source_and_incident_ids(spark, d):
    recalls = table(spark, d, "recalls").select(F.lit("recalls").alias("feed"), "row_id", N.recall_source_id().alias("source_id"), N.recall_incident_id().alias("incident_id"))
    short = table(spark, d, "shortages").select(F.lit("shortages").alias("feed"), "row_id", N.shortage_source_id().alias("source_id"), N.shortage_incident_id().alias("incident_id"))
    return recalls.unionByName(short)


_CONTEXT = lambda fields: "'{' || array_to_string(list_filter([" + ", ".join(f"case when trim({f}) <> '' then '\"{f}\":' || to_json(trim({f}))::varchar end" for f in fields) + "], lambda x: x is not null), ',') || '}'"


@query(f"""select 'recalls' as feed, row_id, {_CONTEXT(N.CONTEXT_FIELDS['recalls'])} as context, nullif(trim(reason_for_recall), '') as raw_text from recalls
union all select 'shortages', row_id, {_CONTEXT(N.CONTEXT_FIELDS['shortages'])}, nullif(trim(shortage_reason), '') from shortages""")
def record_context(spark, d):
    def one(feed: str, text: str) -> DataFrame:
        return table(spark, d, feed).select(F.lit(feed).alias("feed"), "row_id", F.to_json(N.context(N.CONTEXT_FIELDS[feed])).alias("context"), F.nullif(F.trim(text), F.lit("")).alias("raw_text"))

    return one("recalls", "reason_for_recall").unionByName(one("shortages", "shortage_reason"))


_RECALL_KEY = "case when coalesce(recall_number, '') <> '' then 'recall_number' else 'fallback' end as kind, case when coalesce(recall_number, '') <> '' then recall_number else concat_ws(chr(31), coalesce(event_id, ''), coalesce(recall_initiation_date, ''), coalesce(recalling_firm, ''), coalesce(product_description, '')) end as recall_key"


@query(f"""with n as (select distinct snapshot, dense_rank() over (order by snapshot desc) as r from recalls), k as (select r, {_RECALL_KEY} from recalls join n using (snapshot) where r <= 2)
select kind, recall_key from k where r = 1 except select kind, recall_key from k where r = 2""")
def new_recalls(spark, d):
    """Recalls of the latest snapshot whose key the one before it lacks; a record without number is known by what else it says."""
    df = table(spark, d, "recalls")
    last = sorted(r[0] for r in df.select("snapshot").where(F.col("snapshot").isNotNull()).distinct().collect())[-2:]
    numbered = F.coalesce("recall_number", F.lit("")) != ""
    fallback = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("")) for c in ("event_id", "recall_initiation_date", "recalling_firm", "product_description")])
    key = [F.when(numbered, "recall_number").otherwise("fallback").alias("kind"), F.when(numbered, F.col("recall_number")).otherwise(fallback).alias("recall_key")]
    side = lambda i: df.where(F.col("snapshot").isin(last[i : i + 1 or None])).select(*key).distinct()
    return side(-1).join(side(-2), ["kind", "recall_key"], "left_anti") if len(last) > 1 else side(-1)


# Rows by what they tell


@query(f"""select case when trim(coalesce(shortage_reason, '')) = '' then 'missing' when lower(trim(shortage_reason)) = 'other' then 'other' else 'reason' end as bucket, count(*) as records,
count(distinct package_ndc) as packages, count(*) filter (where lower({N.sql_strip('status')}) = 'current') as current_records from {_now('shortages')} group by 1""")
def reason_buckets(spark, d):
    text = F.trim(F.coalesce("shortage_reason", F.lit("")))
    bucket = F.when(text == "", "missing").when(F.lower(text) == "other", "other").otherwise("reason")
    current = F.coalesce(F.lower(strip(F.col("status"))) == "current", F.lit(False))
    return _latest(spark, d, "shortages").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("records"), F.countDistinct("package_ndc").alias("packages"), F.count_if(current).alias("current_records"))


@query(f"""select row_id, generic_name, company_name from {_now('shortages')} where lower({N.sql_strip('status')}) = 'current' and (contains(lower(coalesce(generic_name, '')), 'sodium') or contains(lower(coalesce(company_name, '')), 'sodium'))
and lower(trim(coalesce(company_name, ''))) in (select lower(trim(company_name)) from (select company_name, count(*) as n from {_now('shortages')} where trim(company_name) <> '' group by 1 order by n desc, company_name limit 25))""")
def combined_search(spark, d):
    """Current shortages of the 25 firms with most rows whose generic or firm name holds ``sodium``: optional filters, chained."""
    rows = _latest(spark, d, "shortages")
    firms = rows.where(F.trim("company_name") != "").groupBy("company_name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "company_name").limit(25)
    firms = firms.select(F.lower(F.trim("company_name")).alias("firm")).distinct()
    return search(rows.join(F.broadcast(firms), F.lower(F.trim("company_name")) == F.col("firm"), "left_semi"), "Sodium ", status="current").select("row_id", "generic_name", "company_name")


def search(rows: DataFrame, needle: str = "", status: str | None = None, maker: str | None = None) -> DataFrame:
    """Rows that pass every filter stated: status and maker without case, the needle in the generic or firm name."""
    if status:
        rows = rows.where(F.lower(strip(F.col("status"))) == status.strip().lower())
    if maker:
        rows = rows.where(F.lower(F.trim("company_name")) == maker.strip().lower())
    if needle.strip():
        low = F.lit(needle.strip().lower())
        rows = rows.where(F.contains(F.lower(F.coalesce("generic_name", F.lit(""))), low) | F.contains(F.lower(F.coalesce("company_name", F.lit(""))), low))
    return rows


@query(f"""with src as (select distinct candidate_id, raw_text from phase12_examples), {_sql_classified('src', 'raw_text', 'candidate_id')}
select candidate_id from classified where confidence = 'high' and confidence_score = 1.0 and len(m) = 1""")
def fast_mode(spark, d):
    """Records whose rules leave nothing to decide: one category, high confidence, full score."""
    rows = spread(table(spark, d, "phase12_examples").select("candidate_id", "raw_text").distinct())
    out = classify.classify(rows, F.col("raw_text"))
    return out.where((F.col("confidence") == "high") & (F.col("confidence_score") == 1.0) & ~F.contains("matched", F.lit("|")) & (F.col("matched") != "")).select("candidate_id")


@query("""with c as (select event.primary_cause as cause, count(distinct candidate_id) as n, count(distinct incident_id) as i, count(distinct reason_text_id) as t from phase12_examples where event.primary_cause is not null group by 1)
select count(*) as categories, count(*) filter (where i >= 3 and t >= 3) as eligible, arg_max(cause, {'n': n, 'c': cause}) as majority, round(100.0 * max(n) / sum(n), 4) as majority_pct from c""")
def category_balance(spark, d):
    c = table(spark, d, "phase12_examples").where(F.col("event.primary_cause").isNotNull()).groupBy(F.col("event.primary_cause").alias("cause")).agg(F.countDistinct("candidate_id").alias("n"), F.countDistinct("incident_id").alias("i"), F.countDistinct("reason_text_id").alias("t"))
    return c.agg(F.count(F.lit(1)).alias("categories"), F.count_if((F.col("i") >= 3) & (F.col("t") >= 3)).alias("eligible"), F.max_by("cause", F.struct("n", "cause")).alias("majority"), F.round(F.try_divide(100.0 * F.max("n"), F.sum("n")), 4).alias("majority_pct"))


@query(f"""select count(*) as records, count(*) filter (where trim(coalesce(shortage_reason, '')) = '') as without_reason, count(distinct lower(trim(generic_name))) as drugs, count(distinct lower(trim(company_name))) as firms,
count(distinct package_ndc) as packages, min(snapshot) as snapshot from {_now('shortages')}""")
def metadata_rollup(spark, d):
    low = lambda c: F.lower(F.trim(c))
    return _latest(spark, d, "shortages").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.trim(F.coalesce("shortage_reason", F.lit(""))) == "").alias("without_reason"), F.countDistinct(low("generic_name")).alias("drugs"), F.countDistinct(low("company_name")).alias("firms"), F.countDistinct("package_ndc").alias("packages"), F.min("snapshot").alias("snapshot"))


@query(f"""with r as (select event_id, {N.sql_reason('reason_for_recall')} as text, coalesce(nullif(upper(trim(classification)), ''), 'NONE') as class from {_now('recalls')}), c as (select event_id, text, class, count(*) as n from r group by all)
select event_id, text, string_agg(class || '=' || n, '|' order by class) as classes from c group by event_id, text""")
def recall_context_counts(spark, d):
    """Per event and text how many filings of each class, as a map shown in order of its keys; a map has one entry a class."""
    rows = _latest(spark, d, "recalls").select("event_id", N.reason_text(F.col("reason_for_recall")).alias("text"), F.coalesce(F.nullif(F.upper(F.trim("classification")), F.lit("")), F.lit("NONE")).alias("class"))
    counts = rows.groupBy("event_id", "text", "class").agg(F.count(F.lit(1)).alias("n"))
    classes = F.map_from_entries(F.collect_list(F.struct("class", "n")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("classes")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), "|")
    return counts.groupBy("event_id", "text").agg(classes.alias("classes")).select("event_id", "text", shown.alias("classes"))


# Provenance and completeness


@query("""with l as (select candidate_id, count(distinct b) as n, min(b) as b from (select candidate_id, (coalesce(source, '-'), coalesce(raw_text, '-')) as b from phase11_examples where annotation_origin = 'teacher') where candidate_id is not null group by 1),
c as (select candidate_id, count(distinct b) as n, min(b) as b from (select candidate_id, (coalesce(source, '-'), coalesce(raw_text, '-')) as b from phase11_examples where split in ('train', 'validation', 'test')) where candidate_id is not null group by 1)
select candidate_id, case when c.n is null then 'no_candidate' when l.n > 1 then 'duplicate_label' when c.n > 1 then 'duplicate_candidate' when l.b <> c.b then 'differs' else 'agrees' end as outcome from l left join c using (candidate_id)""")
def provenance_join(spark, d):
    """Teacher labels against the records that the splits hold: source and text must be the same."""
    rows = table(spark, d, "phase11_examples")
    return modeling.provenance(rows.where("annotation_origin = 'teacher'"), rows.where(F.col("split").isin("train", "validation", "test")), "candidate_id", ("source", "raw_text"))


@query("""with s as (select 'candidates' as kind, candidate_id as x, split from phase11_examples union all select 'texts', reason_text_id, split from phase11_examples),
a as (select distinct kind, x from s where split = 'train'), b as (select distinct kind, x from s where split = 'test')
select k.kind, count(*) filter (where b.kind is null) = 0 and count(*) filter (where a.kind is null) = 0 as equal, count(*) filter (where b.kind is null) as only_a, count(*) filter (where a.kind is null) as only_b
from (select unnest(['candidates', 'texts']) as kind) k join (select coalesce(a.kind, b.kind) as kind, a, b from a full join b on a.kind = b.kind and a.x is not distinct from b.x) j using (kind) group by k.kind""".replace("coalesce(a.kind, b.kind) as kind, a, b from", "coalesce(a.kind, b.kind) as kind, {'kind': a.kind} as a, {'kind': b.kind} as b from"))
def set_equality(spark, d):
    """Whether train and test hold the same candidates and the same texts, and how many only one of them holds."""
    rows = table(spark, d, "phase11_examples")
    side = lambda s, c: rows.where(F.col("split") == s).select(c)
    parts = [modeling.same_set(side("train", c), side("test", c)).select(F.lit(kind).alias("kind"), "*") for kind, c in (("candidates", "candidate_id"), ("texts", "reason_text_id"))]
    return parts[0].unionByName(parts[1])


@query("""with p as (select distinct candidate_id, annotation_origin, incident_id, reason_text_id from phase11_examples), g as (select distinct incident_id, reason_text_id from p where annotation_origin = 'gold' and incident_id is not null and reason_text_id is not null)
select candidate_id from p where annotation_origin <> 'gold' and not exists (select 1 from g where g.incident_id = p.incident_id and g.reason_text_id = p.reason_text_id)""")
def gold_pair_exclusion(spark, d):
    """Records whose incident and text are not together those of a gold record."""
    rows = table(spark, d, "phase11_examples").select("candidate_id", "annotation_origin", *_LEAKS).distinct()
    return rows.where("annotation_origin <> 'gold'").join(rows.where("annotation_origin = 'gold'").select(*_LEAKS), list(_LEAKS), "left_anti").select("candidate_id")


# Builders

_REACH = """e as (select distinct candidate_id as node, x as entity from (select candidate_id, unnest([nullif('i:' || lower(regexp_replace(incident_id, '\\s', '', 'g')), 'i:'), nullif('t:' || lower(regexp_replace(reason_text_id, '\\s', '', 'g')), 't:')]) as x from b) where x is not null)"""


@query(f"""with recursive b as (select distinct candidate_id, source, incident_id, raw_text, 'reason:' || sha256({N.sql_reason('raw_text')}) as reason_text_id from phase12_examples), {_REACH},
reach(node, other) as (select node, node from e union select r.node, b.node from reach r join e a on a.node = r.other join e b on b.entity = a.entity), g as (select node as candidate_id, min(other) as split_group from reach group by node),
p as (select incident_id, reason_text_id, count(*) as filings from b group by all), t as (select reason_text_id, count(*) as incidents from p group by all)
select candidate_id, source, b.incident_id, b.reason_text_id, split_group, filings, incidents, 1.0::double / (filings * incidents) as weight from b join g using (candidate_id)
join p on p.incident_id is not distinct from b.incident_id and p.reason_text_id = b.reason_text_id join t on t.reason_text_id = b.reason_text_id""")
def modeling_examples(spark, d):
    """Examples with text ids, tied groups, counts and weights worked out anew from incidents and texts."""
    base = table(spark, d, "phase12_examples").select("candidate_id", "source", "incident_id", N.stable_id("reason", N.reason_text(F.col("raw_text"))).alias("reason_text_id"), "raw_text").distinct()
    base = materialise(base, "examples")
    sets = components.components(components.ties(base, "candidate_id", _LEAKS)).select(F.col("node").alias("candidate_id"), F.col("label").alias("split_group"))
    each = base.withColumn("_row", F.sha2(F.to_json(F.struct("candidate_id", "incident_id", "raw_text", "source")), 256))
    weight = modeling.weights(each, "_row", "incident_id", "reason_text_id")
    return each.join(weight, "_row").join(sets, "candidate_id").select("candidate_id", "source", "incident_id", "reason_text_id", "split_group", "filings", "incidents", "weight")


@query(f"""with recursive b as (select distinct candidate_id, annotation_origin, incident_id, reason_text_id from phase11_examples), {_REACH},
tied(node) as (select candidate_id from b where annotation_origin = 'gold' union select b2.node from tied t join e a on a.node = t.node join e b2 on b2.entity = a.entity),
k as (select *, annotation_origin = 'gold' as gold, candidate_id in (select node from tied) as near from b), t as (select reason_text_id, count(distinct coalesce(incident_id, '')) as incidents from k where not near group by 1)
select candidate_id, incident_id, k.reason_text_id, not near as training_eligible, case when gold then 'gold_held_out' when near then 'gold_connected_incident_or_reason_text' else '' end as exclusion,
case when near then 1.0::double else 1.0::double / incidents end as weight from k left join t on t.reason_text_id is not distinct from k.reason_text_id""")
def distillation_pool(spark, d):
    """The pool of all sources: gold is held out, what any chain ties to gold is excluded, the rest is weighted by the incidents of its text."""
    rows = materialise(table(spark, d, "phase11_examples").select("candidate_id", "annotation_origin", *_LEAKS).distinct(), "pool")
    sets = components.components(components.ties(rows, "candidate_id", _LEAKS))
    node = components.record_node(rows.select("candidate_id", *_LEAKS), "candidate_id")
    tied = rows.withColumn("node", node).join(sets, "node", "left").withColumn("label", F.coalesce("label", "node"))
    is_gold = F.col("annotation_origin") == "gold"
    near = tied.where(is_gold).select("label").distinct().withColumn("near", F.lit(True))
    tied = tied.join(near, "label", "left").withColumn("near", F.coalesce("near", F.lit(False)))
    texts = tied.where(~F.col("near")).groupBy("reason_text_id").agg(F.countDistinct(F.coalesce("incident_id", F.lit(""))).alias("incidents")).withColumnRenamed("reason_text_id", "_text")
    out = tied.join(texts, F.col("reason_text_id").eqNullSafe(F.col("_text")), "left")
    exclusion = F.when(is_gold, "gold_held_out").when(F.col("near"), "gold_connected_incident_or_reason_text").otherwise("")
    return out.select("candidate_id", *_LEAKS, (~F.col("near")).alias("training_eligible"), exclusion.alias("exclusion"), F.when(F.col("near"), 1.0).otherwise(1.0 / F.col("incidents")).alias("weight"))


@query("""with e as (select distinct candidate_id, event.primary_cause as label from phase12_examples where event.primary_cause is not null), s as (select label, count(*) as n from e group by 1), total as (select cast(round_even(sum(n) * 0.15, 0) as bigint) as t from s),
v1 as (select label, n, case when n >= 3 and row_number() over (order by n >= 3 desc, n desc, label desc) <= (select t from total) then 1 else 0 end as r from s), slots1 as (select label, n, r, unnest(range(r + 1, n)) as k from v1),
v as (select label, count(*) as extra from (select label from slots1 order by 0.15 * n - (k - 1) desc, n desc, label desc limit (select t - (select sum(r) from v1) from total)) group by label),
val as (select v1.label, n, r + coalesce(extra, 0) as v from v1 left join v using (label)), t1 as (select label, n - v as n, case when n >= 3 and row_number() over (order by n >= 3 desc, n - v desc, label desc) <= (select t from total) then 1 else 0 end as r from val), slots2 as (select label, n, r, unnest(range(r + 1, n)) as k from t1),
t as (select label, count(*) as extra from (select label from slots2 order by 0.15 * n - (k - 1) desc, n desc, label desc limit (select t - (select sum(r) from t1) from total)) group by label),
c as (select val.label, v, r + coalesce(extra, 0) as t from val join t1 using (label) left join t using (label)), ranked as (select candidate_id, label, row_number() over (partition by label order by sha256('seed|' || candidate_id), candidate_id) as r from e)
select candidate_id, label, case when r <= v then 'validation' when r <= v + t then 'test' else 'train' end as split from ranked join c using (label)""")
def exact_split(spark, d):
    rows = table(spark, d, "phase12_examples").where(F.col("event.primary_cause").isNotNull()).select("candidate_id", F.col("event.primary_cause").alias("label")).distinct()
    return modeling.exact_split(rows, "candidate_id", "label")


# How many candidates each category gets in a hand-labelled sample.
TARGETS = {
    "active_ingredient_shortage": 20, "inactive_ingredient_shortage": 4, "manufacturing_quality_problem": 70, "manufacturing_capacity": 15, "regulatory_delay": 3, "shipping_delay": 25, "demand_increase": 25,
    "product_discontinuation": 25, "labeling_packaging_error": 50, "regulatory_noncompliance": 45, "adverse_event_signal": 40, "recall": 70, "unknown": 8,
}


def _sql_pick(pool: str, name: str, by: str, quota: str, seed: str) -> str:
    ranked = lambda src, s: f"(select *, row_number() over (partition by g order by again, h, candidate_id) as n from (select *, row_number() over (partition by g, raw_text order by h, candidate_id) > 1 as again from (select *, {by} as g, {quota} as q, sha256('{s}|' || candidate_id) as h from {src})))"
    return f"""{name}_edge as (select candidate_id, g from {ranked(f"(select * from {pool} where edge)", seed)} where n <= round_even(q * 0.4, 0)),
{name} as (select candidate_id, g from {name}_edge union all select r.candidate_id, r.g from {ranked(f"(select * from {pool} where candidate_id not in (select candidate_id from {name}_edge))", f'{seed}+1')} r
  left join (select g, count(*) as had from {name}_edge group by g) h on h.g = r.g where n <= q - coalesce(had, 0))"""


@query(f"""with src as (select distinct candidate_id, source, raw_text, event.primary_cause as cause_label from phase12_examples where event.primary_cause is not null), {_sql_classified('src', 'raw_text', 'candidate_id, source, raw_text, cause_label')},
pool as (select candidate_id, raw_text, cause_label as label, confidence <> 'high' or len(m) > 1 as edge, source = 'recall' and regexp_matches(coalesce(raw_text, ''), '(?i)production|manufactur|facility|plant|equipment|supply')
  and regexp_matches(coalesce(raw_text, ''), '(?i)capacity|unable|cannot|could not|delay|shortage|interruption|shutdown|closed|closure|out of business|production issue|equipment failure') as pressed from classified),
first_pool as (select * from pool where label = 'manufacturing_capacity' or pressed), {_sql_pick('first_pool', 'one', "'manufacturing_capacity'", '15', 'capacity')},
rest_pool as (select * from pool where candidate_id not in (select candidate_id from one) and label <> 'manufacturing_capacity'),
{_sql_pick('rest_pool', 'two', 'label', "case label " + ' '.join(f"when '{k}' then {v}" for k, v in TARGETS.items()) + " end", 'rest')}
select candidate_id, g as stratum from one union all select candidate_id, g from two""")
def quota_sample(spark, d):
    """A sample for labelling by hand: fixed quotas a category, two fifths from the edge, capacity first, no record twice."""
    rows = spread(table(spark, d, "phase12_examples").where(F.col("event.primary_cause").isNotNull()).select("candidate_id", "source", "raw_text", F.col("event.primary_cause").alias("label")).distinct())
    pool = materialise(classify.classify(rows, F.col("raw_text")), "quota-pool")
    edge = (F.col("confidence") != "high") | F.contains("matched", F.lit("|"))
    pressed = (F.col("source") == "recall") & classify.in_family(F.col("raw_text"), classify.CAPACITY_CONTEXT) & classify.in_family(F.col("raw_text"), classify.CAPACITY_PRESSURE)
    capacity = pool.where((F.col("label") == "manufacturing_capacity") | F.coalesce(pressed, F.lit(False))).withColumn("stratum", F.lit("manufacturing_capacity"))
    one = materialise(modeling.quota_sample(capacity, "stratum", "raw_text", "candidate_id", {"manufacturing_capacity": TARGETS["manufacturing_capacity"]}, edge, "capacity").select("candidate_id", "stratum"), "quota-one")
    rest = pool.where(F.col("label") != "manufacturing_capacity").join(one.select("candidate_id"), "candidate_id", "left_anti").withColumn("stratum", F.col("label"))
    two = modeling.quota_sample(rest, "stratum", "raw_text", "candidate_id", TARGETS, edge, "rest").select("candidate_id", "stratum")
    return one.unionByName(two)


@query("""with u as (select distinct candidate_id, source, raw_text, sha256('pilot|' || candidate_id) as h from phase11_examples where trim(raw_text) <> '' and candidate_id is not null), k as (select *, source = 'recall' and regexp_matches(raw_text, '(?i)temperature|delivery system|subpotent|imprint|excipient|shipping|transit|mislab') as edge from u),
a as (select candidate_id from k where source = 'shortage' order by h, candidate_id limit 10), b as (select candidate_id from k where edge order by h, candidate_id limit 15),
c as (select candidate_id from k where candidate_id not in (select candidate_id from a union all select candidate_id from b) order by case when source = 'recall' and not edge then 0 when edge then 1 else 2 end, h, candidate_id limit 50 - (select count(*) from a) - (select count(*) from b))
select 'shortage' as part, candidate_id from a union all select 'edge', candidate_id from b union all select 'rest', candidate_id from c""")
def pilot_units(spark, d):
    """A pilot of fifty: a fifth shortages, three tenths recalls of the edge, the rest others; a fixed top by definition."""
    size = 50
    rows = spread(table(spark, d, "phase11_examples").where((F.trim("raw_text") != "") & F.col("candidate_id").isNotNull()).select("candidate_id", "source", "raw_text").distinct())
    rows = materialise(rows.select("candidate_id", "source", modeling.seeded("candidate_id", "pilot").alias("h"), ((F.col("source") == "recall") & classify.in_family(F.col("raw_text"), classify.PILOT_EDGE)).alias("edge")), "pilot")
    top = lambda df, n, *first: df.orderBy(*first, "h", "candidate_id").limit(n).select("candidate_id")
    a, b = top(rows.where("source = 'shortage'"), max(1, round(size * 0.2))), top(rows.where("edge"), max(1, round(size * 0.3)))
    chosen = materialise(a.select(F.lit("shortage").alias("part"), "*").unionByName(b.select(F.lit("edge").alias("part"), "*")), "pilot-first")
    order = F.when((F.col("source") == "recall") & ~F.col("edge"), 0).when(F.col("edge"), 1).otherwise(2)
    rest = top(rows.join(chosen.select("candidate_id"), "candidate_id", "left_anti"), max(0, size - chosen.count()), order)
    return chosen.unionByName(rest.select(F.lit("rest").alias("part"), "*"))
