"""Queries of the general problems: snapshot changes, instants, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import names as N
from apothecary.functions.instants import SOURCE_ZONES, parse_instant
from apothecary.operators import nested, snapshots
from apothecary.session import materialise
from apothecary.sources.tables import table


def _feeds(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"recalls": table(spark, d, "recalls"), "shortages": table(spark, d, "shortages")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.changes(spark, _feeds(spark, d)).select("feed", "snapshot", "record_key", "change_kind")


def p2_field_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.field_changes(spark, _feeds(spark, d))


def _instants(spark: SparkSession, d: str, **policy) -> DataFrame:
    dates = {"shortages": "initial_posting_date", "recalls": "recall_initiation_date"}
    rows = [table(spark, d, feed).select(F.lit(feed).alias("feed"), "row_id", F.col(c).alias("value")) for feed, c in dates.items()]
    zone = F.when(F.col("feed") == "shortages", SOURCE_ZONES["shortages"]).otherwise(SOURCE_ZONES["recalls"])
    return parse_instant(rows[0].unionByName(rows[1]), "value", zone, **policy)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _instants(spark, d).where(F.col("instant_us").isNotNull()).select("feed", "row_id", F.col("instant_us").alias("utc_us"))


def p4_formats(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each feed came in which format and local-time case; NULL format: no valid value."""
    rows = _instants(spark, d).withColumn("instant_format", F.when(F.col("instant_us").isNotNull(), F.col("instant_format")))
    return rows.groupBy("feed", F.col("instant_format").alias("format"), "instant_case").agg(F.count(F.lit(1)).alias("n"))


def _nested(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Every place of every object, written once: objects and bridge both come from it."""
    every = nested.all_occurrences(table(spark, d, "ndc"), table(spark, d, "drugsfda"), table(spark, d, "raw_feed"))
    return materialise(every.select(*columns or ["*"]), "nested-places")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    links = _nested(spark, d, "feed", "record_id", "path", "ordinals", "object_id")
    return nested.places(links, nested.identities(links))


def p7_flat(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables put together from bridge and objects; ordinals and identities as text."""
    places = _nested(spark, d)
    return _shown(nested.flat(nested.bridge(places), nested.objects(places)).drop("ordinals"))


def p7_objects(spark: SparkSession, d: str) -> DataFrame:
    return _shown(nested.objects(_nested(spark, d)))


def p7_bridge(spark: SparkSession, d: str) -> DataFrame:
    links = nested.bridge(_nested(spark, d))
    return _shown(links.withColumn("ordinals", F.array_join("ordinals", ".")))


def _shown(df: DataFrame) -> DataFrame:
    """Identities in hexadecimal digits."""
    return df.withColumns({c: F.lower(F.hex(c)) for c, kind in df.dtypes if kind == "binary"})


QUERIES = {f.__name__: f for f in (p2_found, p2_field_changes, p4_found, p4_formats, p7_found, p7_flat, p7_objects, p7_bridge)}

_OBJECT = "json_type(e) = 'OBJECT' and len(list_filter(json_extract(e, '$.*'), lambda x: json_type(x) <> 'NULL')) > 0"


def _items(text: str) -> str:
    """List of JSON elements of a text that is a list or a lone object."""
    return f"case when not coalesce(json_valid({text}), false) then [] when json_type({text}::json) = 'ARRAY' then json_extract({text}::json, '$[*]') when json_type({text}::json) = 'OBJECT' then [{text}::json] else [] end"


def _field(of: str, name: str) -> str:
    return f"case when json_type(json_extract({of}, '$.{name}')) = 'VARCHAR' then json_extract_string({of}, '$.{name}') else json_extract({of}, '$.{name}')::varchar end"


def _body(skip: str) -> str:
    """Scalar fields of the object ``e`` as text in name order, as JSON."""
    kept = f"list_filter(list_sort(json_keys(e)), lambda k: json_type(json_extract(e, '$.' || k)) <> 'NULL' and k <> {skip})"
    return f"'{{' || coalesce(array_to_string(list_transform({kept}, lambda k: to_json(k)::varchar || ':' || to_json(json_extract_string(e, '$.' || k))::varchar), ','), '') || '}}'"


#: The nested lists of both feeds and the list nested in each, for the SQL.
_LISTS = {"ndc": ("product_id", {"active_ingredients": "", "packaging": ""}), "drugsfda": ("application_number", {"products": "active_ingredients", "submissions": "application_docs"})}


def _nested_sql(show: str) -> str:
    parts = []
    for feed, (key, lists) in _LISTS.items():
        for field, child in lists.items():
            parts.append(f"select '{feed}' as feed, {key} as record_id, '{field}' as path, '{child}' as child, to_json({field})::varchar as t from {feed} where {key} is not null and {field} is not null")
            parts.append(f"select 'raw_feed', raw_id::varchar, '{field}', '{child}', {_field('payload::json', field)} from sound where feed = '{feed}'")
    return f"""with sound as (select raw_id, feed, payload from raw_feed where coalesce(json_valid(payload), false) and json_type(case when json_valid(payload) then payload::json end) = 'OBJECT'),
lists as ({' union '.join(parts)}), outer_items as (select feed, record_id, path, child, pos, l[pos] as e from (select *, unnest(range(1, len(l) + 1)) as pos from (select *, {_items('t')} as l from lists))),
kept as (select row_number() over () as n, * from outer_items where {_OBJECT}),
inner_items as (select n, feed, record_id, path || '.' || child as path, pos, sub_pos, l[sub_pos] as e from (select *, unnest(range(1, len(l) + 1)) as sub_pos from (select *, {_items('c')} as l from
  (select *, case when json_type(json_extract(e, '$.' || child)) = 'VARCHAR' then json_extract_string(e, '$.' || child) else json_extract(e, '$.' || child)::varchar end as c from kept where child <> '')))),
small as (select *, substr(sha256(path || chr(31) || body || chr(31)), 1, 32) as id from (select *, {_body("''")} as body from inner_items where {_OBJECT})),
refs as (select n, string_agg(path || ':' || sub_pos || ':' || id, '|' order by sub_pos) as refs from small group by n),
large as (select *, substr(sha256(path || chr(31) || body || chr(31) || coalesce(refs, '')), 1, 32) as id from (select k.*, refs, {_body('child')} as body from kept k left join refs using (n))),
places as (select distinct feed, record_id, path, pos, 0::bigint as sub_pos, pos::varchar as ordinals, null as parent_id, id as object_id, body from large
  union select s.feed, s.record_id, s.path, s.pos, s.sub_pos, s.pos || '.' || s.sub_pos, l.id, s.id, s.body from small s join large l using (n))
{show}"""


_CHANGES = f"""with rows as (select 'recalls' as feed, snapshot, nullif(upper({N.sql_strip('recall_number')}), '') as k, ingested_at, row_id, lower({N.sql_strip('status')}) as a, lower({N.sql_strip('classification')}) as b from recalls
  union all select 'shortages', snapshot, case when length({N.sql_ndc('package_ndc')}) = 11 then {N.sql_ndc('package_ndc')} end, ingested_at, row_id, lower({N.sql_strip('status')}), lower({N.sql_strip('availability')}) from shortages),
last as (select feed, snapshot, k, a, b from (select *, row_number() over (partition by feed, snapshot, k order by ingested_at desc nulls last, row_id desc) as r from rows where k is not null and snapshot is not null) where r = 1),
names as (select snapshot, lead(snapshot) over (order by snapshot) as later from (select distinct snapshot from rows where snapshot is not null)),
old as (select l.feed, n.later as snapshot, l.k, a, b from last l join names n using (snapshot) where n.later is not null),
new as (select l.* from last l where snapshot in (select later from names))
select coalesce(o.feed, n.feed) as feed, coalesce(o.snapshot, n.snapshot) as snapshot, coalesce(o.k, n.k) as record_key, case when o.k is null then 'added' when n.k is null then 'removed' else 'changed' end as change_kind
from old o full join new n on o.feed = n.feed and o.snapshot = n.snapshot and o.k = n.k where o.k is null or n.k is null or o.a is distinct from n.a or o.b is distinct from n.b"""

_FIELD_CHANGES = f"""with rows as (select 'recalls' as feed, snapshot, nullif(upper({N.sql_strip('recall_number')}), '') as k, ingested_at, row_id, status as a, classification as b from recalls
  union all select 'shortages', snapshot, case when length({N.sql_ndc('package_ndc')}) = 11 then {N.sql_ndc('package_ndc')} end, ingested_at, row_id, status, availability from shortages),
last as (select feed, snapshot, k, a, b from (select *, row_number() over (partition by feed, snapshot, k order by ingested_at desc nulls last, row_id desc) as r from rows where k is not null and snapshot is not null) where r = 1),
names as (select snapshot, lead(snapshot) over (order by snapshot) as later from (select distinct snapshot from rows where snapshot is not null)),
pairs as (select n.feed, n.snapshot, n.k, o.a as oa, n.a as na, o.b as ob, n.b as nb from last o join names m using (snapshot) join last n on n.snapshot = m.later and n.feed = o.feed and n.k = o.k)
select feed, snapshot, k as record_key, 'status' as field, oa as old_value, na as new_value from pairs where lower({N.sql_strip('oa')}) is distinct from lower({N.sql_strip('na')})
union all select feed, snapshot, k, case when feed = 'recalls' then 'classification' else 'availability' end, ob, nb from pairs where lower({N.sql_strip('ob')}) is distinct from lower({N.sql_strip('nb')})"""

_CLOCK = r"(?:(?:[T ]|, ?| +)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([ap])\.?m\b\.?)?(?: ?(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|[a-z]{2,5}|[a-z]+(?:/[a-z_+-]+)+))?)?"
_MONTH = r"((?:january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|may|jun|jul|aug|sept|sep|oct|nov|dec)\.?)"
#: Format, date pattern and what its groups are. Two patterns share a name where only the separator differs.
_SHAPES = (
    ("iso", r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})", "ymd"), ("month_first", r"(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})", "mdy"), ("month_first", r"(\d{1,2})-(\d{1,2})-(\d{4}|\d{2})", "mdy"),
    ("day_first", r"(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})", "dmy"), ("day_month_name", rf"(?:[a-z]{{3,9}}, ?)?(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}}|\d{{2}})", "dmy"), ("month_name_day", rf"(?:[a-z]{{3,9}}, ?)?{_MONTH} (\d{{1,2}}),? (\d{{4}})", "mdy"),
)
_PARTS = "{{'f': '{f}', 'y': x.y, 'm': x.m, 'd': x.d, 'h': x.h, 'mi': x.mi, 's': x.s, 'u': x.u, 'ap': x.ap, 'z': x.z}}"


def _shape(name: str, pattern: str, order: str) -> str:
    groups = ", ".join(f"'{c}'" for c in (*order, "h", "mi", "s", "u", "ap", "z"))
    return f"when regexp_matches(v, '(?i)^{pattern}{_CLOCK}$') then list_transform([regexp_extract(v, '(?i)^{pattern}{_CLOCK}$', [{groups}])], lambda x: {_PARTS.format(f=name)})[1]"


_COMPACT_SQL = r"^(\d{4})(\d{2})(\d{2})(?:[T ]?(\d{2})(\d{2})(\d{2})(?:\.(\d+))?(Z|[+-]\d{2}:?\d{2})?)?$"
_INSTANTS = f"""with v as (select feed, row_id, trim(regexp_replace(value, '\\s+', ' ', 'g')) as v from (select 'recalls' as feed, row_id, recall_initiation_date as value from recalls union all select 'shortages', row_id, initial_posting_date from shortages)),
p as (select feed, row_id, v, case when regexp_matches(v, '^(\\d{{10}}|\\d{{13}})$') then null
  when regexp_matches(v, '{_COMPACT_SQL}') then list_transform([regexp_extract(v, '{_COMPACT_SQL}', ['y', 'm', 'd', 'h', 'mi', 's', 'u', 'z'])], lambda x: {_PARTS.format(f='compact').replace('x.ap', "''")})[1]
  {' '.join(_shape(*x) for x in _SHAPES)} end as x from v),
q as (select feed, row_id, v, x.f as f, x.z as z, lower(x.ap) as ap, try_cast(x.h as int) as h, coalesce(try_cast(nullif(x.mi, '') as int), 0) as mi, coalesce(try_cast(nullif(x.s, '') as int), 0) as s, cast(rpad(substr(x.u, 1, 6), 6, '0') as bigint) as u, x.h <> '' as timed,
  try_cast(case when length(x.y) = 2 then '20' || x.y else x.y end || '-' || lpad(case when regexp_matches(x.m, '^\\d') then x.m else cast((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substr(x.m, 1, 3))) + 2) // 3 as varchar) end, 2, '0') || '-' || lpad(x.d, 2, '0') as date) as day from p),
w as (select *, case when ap = '' then h when h between 1 and 12 then h % 12 + case when ap = 'p' then 12 else 0 end end as hh from q),
c as (select feed, row_id, v, f, z, case when day is null then null when not timed then epoch_us(day::timestamp) when hh between 0 and 23 and mi <= 59 and s <= 59 then epoch_us(day::timestamp) + ((hh * 60 + mi) * 60 + s)::bigint * 1000000 + u end as wall,
  case upper(z) when 'Z' then 0 when 'UT' then 0 when 'UTC' then 0 when 'GMT' then 0 when 'EST' then -300 when 'EDT' then -240 when 'CST' then -360 when 'CDT' then -300 when 'MST' then -420 when 'MDT' then -360 when 'PST' then -480 when 'PDT' then -420 when 'CET' then 60 when 'CEST' then 120 else
  case when regexp_matches(z, '^[+-]') and cast(substr(regexp_replace(z, '[^0-9]', '', 'g'), 1, 2) as int) <= 18 and coalesce(try_cast(substr(regexp_replace(z, '[^0-9]', '', 'g'), 3, 2) as int), 0) <= 59 then
    case when starts_with(z, '-') then -1 else 1 end * (cast(substr(regexp_replace(z, '[^0-9]', '', 'g'), 1, 2) as int) * 60 + coalesce(try_cast(substr(regexp_replace(z, '[^0-9]', '', 'g'), 3, 2) as int), 0)) end end as fixed,
  case when z = '' then 'America/New_York' when contains(z, '/') and z in (select name from pg_timezone_names()) then z end as zone from w),
o as (select *, case when zone is not null and wall is not null then wall - (epoch_us((make_timestamp(wall - 86400000000) at time zone 'UTC') at time zone zone) - (wall - 86400000000)) end as a,
  case when zone is not null and wall is not null then wall - (epoch_us((make_timestamp(wall + 86400000000) at time zone 'UTC') at time zone zone) - (wall + 86400000000)) end as b from c),
k as (select *, epoch_us((make_timestamp(a) at time zone 'UTC') at time zone zone) = wall as fits_a, epoch_us((make_timestamp(b) at time zone 'UTC') at time zone zone) = wall as fits_b from o),
instants as (select feed, row_id, case when regexp_matches(v, '^\\d{{10}}$') then 'epoch_s' when regexp_matches(v, '^\\d{{13}}$') then 'epoch_ms' else f end as format,
  case when regexp_matches(v, '^\\d{{10}}$') then cast(v as bigint) * 1000000 when regexp_matches(v, '^\\d{{13}}$') then cast(v as bigint) * 1000 when fixed is not null then wall - fixed::bigint * 60000000
    when fits_a and fits_b then least(a, b) when fits_b and not fits_a then b else a end as us,
  case when fixed is null and a <> b and fits_a and fits_b then 'ambiguous' when fixed is null and not fits_a and not fits_b then 'nonexistent' else 'plain' end as kind from k)"""

SQL: dict[str, str] = {
    "p4_found": f"{_INSTANTS} select feed, row_id, us as utc_us from instants where us is not null",
    "p4_formats": f"{_INSTANTS} select feed, case when us is not null then format end as format, case when us is null then 'plain' else kind end as instant_case, count(*) as n from instants group by all",
    "p2_field_changes": _FIELD_CHANGES, "p2_found": _CHANGES, 
    "p7_found": _nested_sql("select distinct feed, record_id, path, pos, sub_pos from places"),
    "p7_flat": _nested_sql("select feed, record_id, path, pos, sub_pos, parent_id, object_id, body from places"),
    "p7_bridge": _nested_sql("select feed, record_id, path, ordinals, parent_id, object_id from places"),
    "p7_objects": _nested_sql("select object_id, path, body, count(*) as places from places group by all"),
}
