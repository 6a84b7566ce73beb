"""Queries on cleaning, resolution, graph and traversal of the feeds, each with its oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions import names as N
from apothecary.functions.text import normalize_ndc, strip
from apothecary.operators import graph, market, modeling, resolve
from apothecary.session import materialise, scratch
from apothecary.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
AS_OF = "2026-08-03"


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _latest(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = table(spark, d, name)
    return df.where(F.col("snapshot") == df.agg(F.max("snapshot")).first()[0])




def _now(t: str) -> str:
    return f"(select * from {t} where snapshot = (select max(snapshot) from {t}))"


# Scalars


@query(f"select row_id, {N.sql_ndc('package_ndc')} as code, substr({N.sql_ndc('package_ndc')}, 1, 9) as product_code from shortages")
def ndc_normalize(spark, d):
    n = normalize_ndc(F.col("package_ndc"))
    return table(spark, d, "shortages").select("row_id", n.alias("code"), F.substring(n, 1, 9).alias("product_code"))


@query(f"select distinct recalling_firm as raw, {N.sql_words('recalling_firm')} as words, {N.sql_manufacturer('recalling_firm')} as maker from recalls")
def manufacturer_normalize(spark, d):
    c = F.col("recalling_firm")
    return table(spark, d, "recalls").select(c.alias("raw"), N.words(c).alias("words"), N.normalize_manufacturer(c).alias("maker")).distinct()


@query(f"""select distinct a.name as raw, {N.sql_words('a.name')} as ingredient, replace({N.sql_words('a.strength')}, ' ', '') as strength
from (select unnest(active_ingredients) as a from ndc) where a is not null""")
def ingredient_normalize(spark, d):
    a = table(spark, d, "ndc").select(F.explode("active_ingredients").alias("a")).where(F.col("a").isNotNull())
    return a.select(F.col("a.name").alias("raw"), N.words(F.col("a.name")).alias("ingredient"), N.normalize_strength(F.col("a.strength")).alias("strength")).distinct()


@query("select distinct application_number as raw, nullif(regexp_replace(upper(application_number), '[^A-Z0-9]', '', 'g'), '') as application from ndc")
def application_normalize(spark, d):
    return table(spark, d, "ndc").select(F.col("application_number").alias("raw"), N.normalize_application(F.col("application_number")).alias("application")).distinct()


@query(f"select row_id, {N.sql_reason('reason_for_recall')} as text, 'reason:' || sha256({N.sql_reason('reason_for_recall')}) as reason_text_id, substr(sha256(coalesce(event_id, '')), 1, 10) as event_hash from recalls")
def reason_text_identity(spark, d):
    t = N.reason_text(F.col("reason_for_recall"))
    return table(spark, d, "recalls").select("row_id", t.alias("text"), N.stable_id("reason", t).alias("reason_text_id"), N.short_hash(F.coalesce("event_id", F.lit("")), 10).alias("event_hash"))


@query("""select row_id, coalesce(case when regexp_full_match(initial_posting_date, '\\d{1,2}/\\d{1,2}/\\d{4}') then try_strptime(initial_posting_date, '%m/%d/%Y') end,
  case when regexp_full_match(initial_posting_date, '\\d{8}') then try_strptime(initial_posting_date, '%Y%m%d') end,
  case when regexp_full_match(initial_posting_date, '\\d{4}-\\d{1,2}-\\d{1,2}') then try_strptime(initial_posting_date, '%Y-%m-%d') end,
  case when regexp_full_match(initial_posting_date, '\\d{1,2}-\\d{1,2}-\\d{4}') then try_strptime(initial_posting_date, '%m-%d-%Y') end)::date as day from shortages""")
def multi_format_dates(spark, d):
    return table(spark, d, "shortages").select("row_id", N.feed_date(F.col("initial_posting_date")).alias("day"))


@query("""select row_id, nullif(shortage_reason, '') as shortage_reason, case when status = 'Current' then nullif(related_info, '') end as operational_context,
  case when status = 'To Be Discontinued' then nullif(related_info, '') end as discontinuation_context from shortages""")
def context_fields(spark, d):
    info = F.nullif("related_info", F.lit(""))
    status = F.col("status")
    return table(spark, d, "shortages").select("row_id", F.nullif("shortage_reason", F.lit("")).alias("shortage_reason"), F.when(status == "Current", info).alias("operational_context"), F.when(status == "To Be Discontinued", info).alias("discontinuation_context"))


_FIELDS = ("recall_number", "status", "classification", "recalling_firm", "product_description", "reason_for_recall", "more_code_info", "openfda")


@query("with a as (select count(*) as n from recalls) " + " union all ".join(
    f"select '{c}' as field, count(*) filter (where {c} is null{'' if c == 'openfda' else f" or {c} = ''" }) as missing, coalesce(round(100.0 * count(*) filter (where {c} is null{'' if c == 'openfda' else f" or {c} = ''" }) / nullif((select n from a), 0), 4), 0.0) as pct from recalls" for c in _FIELDS))
def missing_field_metrics(spark, d):
    df = table(spark, d, "recalls")
    kinds = dict(df.dtypes)
    return modeling.missing_report(df, {c: N.missing(F.col(c), kinds[c]) for c in _FIELDS})


@query(f"""select count(distinct labeler_name) as makers_raw, count(distinct coalesce({N.sql_manufacturer('labeler_name')}, {N.sql_words('labeler_name')})) as makers,
  count(distinct generic_name) as generics_raw, count(distinct {N.sql_words('generic_name')}) as generics from ndc""")
def entity_cardinalities(spark, d):
    return table(spark, d, "ndc").agg(F.countDistinct("labeler_name").alias("makers_raw"), F.countDistinct(N.display_key(F.col("labeler_name"))).alias("makers"), F.countDistinct("generic_name").alias("generics_raw"), F.countDistinct(N.words(F.col("generic_name"))).alias("generics"))


# Resolution

_IDENT = f"""ident as (select coalesce(brand_name, '') as brand, coalesce(len(active_ingredients), 0) as ni, coalesce(product_id, '') as pid, {N.sql_words('generic_name')} as generic,
  {N.sql_manufacturer('labeler_name')} as maker, product_ndc, packaging from ndc),
keys as (select 'product' as kind, substr({N.sql_ndc('product_ndc')}, 1, 9) as code, brand, ni, pid, generic, maker from ident
  union all select 'package', {N.sql_ndc('p.package_ndc')}, brand, ni, pid, generic, maker from (select unnest(packaging) as p, * from ident)),
chosen as (select kind, code, count(*) as candidates, count(distinct (coalesce(generic, '?'), coalesce(maker, '?'))) = 1 as agreed,
  arg_max(pid, (brand <> '', ni, pid)) as pid from keys where code is not null group by kind, code)"""
_SHORT = f"""asked as (select row_id, 0 as tier, 0 as pos, 'package_ndc' as method, 'package' as kind, {N.sql_ndc('package_ndc')} as code from {_now('shortages')}
  union all select row_id, 1, 0, 'product_ndc', 'product', substr({N.sql_ndc('package_ndc')}, 1, 9) from {_now('shortages')}
  union all select row_id, 2, pos, 'openfda_package_ndc', 'package', {N.sql_ndc('c')} from (select row_id, unnest(openfda.package_ndc) as c, generate_subscripts(openfda.package_ndc, 1) as pos from {_now('shortages')})
  union all select row_id, 3, pos, 'openfda_product_ndc', 'product', {N.sql_ndc('c')} from (select row_id, unnest(openfda.product_ndc) as c, generate_subscripts(openfda.product_ndc, 1) as pos from {_now('shortages')})),
hit as (select a.row_id, arg_min((a.method, a.code, c.candidates, c.agreed, c.pid), (a.tier, a.pos)) as h from asked a join chosen c using (kind, code) group by a.row_id),
resolved as (select s.row_id, s.status, case when h is null then 'unmatched' when h[4] then h[1] else 'ambiguous_' || h[1] end as method, h[2] as code, coalesce(h[3], 0) as candidates,
  case when h[4] then h[5] end as product_id from {_now('shortages')} s left join hit using (row_id))"""
_SHORT = _SHORT.replace("(a.method, a.code, c.candidates, c.agreed, c.pid)", "{'m': a.method, 'c': a.code, 'n': c.candidates, 'a': c.agreed, 'p': c.pid}").replace("h[4]", "h.a").replace("h[1]", "h.m").replace("h[2]", "h.c").replace("h[3]", "h.n").replace("h[5]", "h.p")
_IDENT = _IDENT.replace("(brand <> '', ni, pid)", "{'b': brand <> '', 'n': ni, 'p': pid}")
_SHORT = _SHORT.replace("(a.tier, a.pos)", "{'t': a.tier, 'p': a.pos}")


def _resolved(spark, d) -> DataFrame:
    return resolve.waterfall(_latest(spark, d, "shortages"), resolve.shortage_tiers(), resolve.directory_keys(table(spark, d, "ndc")))


@query(f"with {_IDENT}, {_SHORT} select row_id, method, code, candidates, product_id from resolved")
def entity_resolution_waterfall(spark, d):
    return _resolved(spark, d)


@query(f"""with {_IDENT}, {_SHORT} select lower({N.sql_strip('status')}) as status, count(*) as records, count(*) filter (where method <> 'unmatched' and not starts_with(method, 'ambiguous_')) as matched,
  round(100.0 * count(*) filter (where method <> 'unmatched' and not starts_with(method, 'ambiguous_')) / count(*), 4) as pct from resolved group by 1""")
def resolution_rate_by_status(spark, d):
    ok = (F.col("method") != "unmatched") & ~F.col("method").startswith("ambiguous_")
    rows = _resolved(spark, d).join(_latest(spark, d, "shortages").select("row_id", "status"), "row_id")
    return rows.groupBy(F.lower(strip(F.col("status"))).alias("status")).agg(F.count(F.lit(1)).alias("records"), F.count_if(ok).alias("matched"), F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 4).alias("pct"))


@query(f"with {_IDENT}, {_SHORT} select method, count(*) as n from resolved group by method")
def resolution_methods(spark, d):
    return _resolved(spark, d).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


_TEXT = r"\b(?:NDC\s*[:#]?\s*)?(\d{4,5}-\d{3,4}-\d{1,2})\b"
_APP = "nullif(regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g'), '')"
_LINKS = f"""dir as (select substr({N.sql_ndc('product_ndc')}, 1, 9) as code, coalesce(product_id, '') as pid from ndc
  union select {N.sql_ndc('p.package_ndc')}, coalesce(product_id, '') from (select unnest(packaging) as p, product_id from ndc)),
carried as (select row_id, 1 as tier, 1 as prio, 'openfda_package_ndc' as method, {N.sql_ndc('c')} as code from (select row_id, unnest(openfda.package_ndc) as c from {_now('recalls')})
  union all select row_id, 1, 2, 'openfda_product_ndc', {N.sql_ndc('c')} from (select row_id, unnest(openfda.product_ndc) as c from {_now('recalls')})
  union all select row_id, 2, 3, 'explicit_ndc_text', {N.sql_ndc('c')} from (select row_id, unnest(regexp_extract_all(concat_ws(' ', product_description, code_info, more_code_info), '(?i){_TEXT}', 1)) as c from {_now('recalls')})),
every as (select row_id, tier, prio, method, pid from carried join dir using (code)
  union all select r.row_id, 3, 4, 'application_number', coalesce(n.product_id, '') from (select row_id, {_APP.format(c='c')} as app from (select row_id, unnest(openfda.application_number) as c from {_now('recalls')})) r
    join (select {_APP.format(c='application_number')} as app, product_id from ndc) n using (app)),
links as (select row_id, pid as product_id, arg_min(method, prio) as method from (select *, min(tier) over (partition by row_id) as best from every) where tier = best group by row_id, pid)"""


def _recall_links(spark, d) -> DataFrame:
    return resolve.recall_links(_latest(spark, d, "recalls"), table(spark, d, "ndc"))


@query(f"with {_LINKS} select row_id, product_id, method from links")
def recall_link_waterfall(spark, d):
    return _recall_links(spark, d)


@query(f"with {_LINKS} select count(*) as records, (select count(distinct row_id) from links) as linked, round(100.0 * (select count(distinct row_id) from links) / count(*), 4) as pct from {_now('recalls')}")
def recall_linkage_rate(spark, d):
    rows = _latest(spark, d, "recalls").select("row_id").join(_recall_links(spark, d).select("row_id", F.lit(1).alias("hit")).distinct(), "row_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("records"), F.count("hit").alias("linked"), F.round(100.0 * F.count("hit") / F.count(F.lit(1)), 4).alias("pct"))


# Graph

_KEY = f"coalesce({N.sql_manufacturer('labeler_name')}, {N.sql_words('labeler_name')})"
_PRODUCTS = f"""products as (select distinct product_id, product_ndc, finished, dosage_form, {N.sql_words('generic_name')} as generic, {N.sql_words('brand_name')} as brand, {_KEY} as maker,
  {_APP.format(c='application_number')} as application from ndc where product_id is not null)"""
_INGR = f"""ingredients as (select distinct product_id, {N.sql_words('a.name')} as ingredient, coalesce(replace({N.sql_words('a.strength')}, ' ', ''), '') as strength
  from (select product_id, unnest(active_ingredients) as a from ndc) where {N.sql_words('a.name')} is not null)"""


@query(f"""with c as (select {_KEY} as norm, labeler_name as name, count(*) as n, min(product_id) as first from ndc where {_KEY} is not null group by 1, 2)
select norm, name, cast(spellings as bigint) as spellings from (select *, row_number() over (partition by norm order by n desc, first) as r, count(*) over (partition by norm) as spellings from c) where r = 1""")
def preferred_display_name(spark, d):
    return graph.display_names(table(spark, d, "ndc"), "labeler_name", F.col("product_id"))


@query(f"select row_number() over (order by maker) as maker_id, maker from (select distinct {_KEY} as maker from ndc) where maker is not null")
def surrogate_dimension(spark, d):
    return graph.surrogate(table(spark, d, "ndc").select(N.display_key(F.col("labeler_name")).alias("maker")), "maker", "maker_id")


@query(f"with {_INGR} select product_id, ingredient, strength from ingredients")
def product_ingredients(spark, d):
    return graph.product_ingredients(table(spark, d, "ndc"))


_CODES = f"""codes as (select product_id, code, case when min(k) = 0 then 'product' else 'package' end as kind from (select product_id, substr({N.sql_ndc('product_ndc')}, 1, 9) as code, 0 as k from ndc
  union all select product_id, {N.sql_ndc('p.package_ndc')}, 1 from (select product_id, unnest(packaging) as p from ndc)) where code is not null group by product_id, code)"""


@query(f"with {_CODES} select product_id, code, kind from codes")
def product_codes(spark, d):
    return graph.product_codes(table(spark, d, "ndc"))


@query(f"with {_CODES}, {_INGR} select distinct code, ingredient from codes join ingredients using (product_id)")
def ndc_active_ingredients_view(spark, d):
    df = table(spark, d, "ndc")
    return graph.product_codes(df).join(graph.product_ingredients(df), "product_id").select("code", "ingredient").distinct()


_A = N.sql_words("a.name"), f"replace({N.sql_words('a.strength')}, ' ', '')"
_MEMBERS = f"""parts as (select product_id, {N.sql_words('dosage_form')} as form, (select string_agg(x, '|' order by x) from (select {N.sql_words('r')} as x from (select unnest(route) as r)) where x is not null) as routes,
  len(active_ingredients) as ni, (select count(*) from (select unnest(active_ingredients) as a) where {_A[0]} is not null and {_A[1]} is not null) as complete,
  (select string_agg(y, '|' order by y) from (select {_A[0]} || '@' || {_A[1]} as y from (select unnest(active_ingredients) as a))) as ing from ndc where finished),
signed as (select distinct product_id, ing || '#' || form || '#' || routes as signature from parts where ni > 0 and complete = ni and form is not null and routes is not null),
members as (select substr(sha256(signature), 1, 24) as group_id, product_id from signed where signature in (select signature from signed group by signature having count(*) > 1))"""


@query(f"with {_MEMBERS} select group_id, product_id from members")
def equivalence_groups(spark, d):
    return graph.equivalence_members(table(spark, d, "ndc"))


@query(f"with {_MEMBERS} select count(*) as groups, coalesce(cast(sum(n) as bigint), 0) as members, coalesce(cast(sum(n * (n - 1)) as bigint), 0) as pairs from (select count(*) as n from members group by group_id)")
def equivalence_pair_count(spark, d):
    return graph.equivalence_counts(graph.equivalence_members(table(spark, d, "ndc")))


@query(f"""with told as (select {_APP.format(c='application_number')} as application, max(coalesce({N.sql_manufacturer('sponsor_name')}, {N.sql_words('sponsor_name')})) as sponsor from drugsfda group by 1),
used as (select distinct {_APP.format(c='application_number')} as application from ndc)
select coalesce(u.application, t.application) as application, sponsor from (select * from used where application is not null) u full join (select * from told where application is not null) t on u.application = t.application""")
def application_sponsor_upsert(spark, d):
    return graph.sponsors(table(spark, d, "drugsfda"), table(spark, d, "ndc"))


@query(f"""with {_PRODUCTS}, {_INGR}, {_CODES} select 'products' as entity, count(distinct product_id) as n from products union all select 'makers', count(distinct maker) from products
union all select 'ingredients', count(distinct ingredient) from ingredients union all select 'codes', count(distinct code) from codes union all select 'product_codes', count(*) from codes""")
def graph_counts(spark, d):
    df = table(spark, d, "ndc")
    products, codes = graph.products(df), graph.product_codes(df)
    n = lambda frame, name, what: frame.agg(F.lit(name).alias("entity"), what.alias("n"))
    parts = [n(products, "products", F.countDistinct("product_id")), n(products, "makers", F.countDistinct("maker")), n(graph.product_ingredients(df), "ingredients", F.countDistinct("ingredient")), n(codes, "codes", F.countDistinct("code")), n(codes, "product_codes", F.count(F.lit(1)))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""with {_PRODUCTS}, {_CODES}, {_LINKS} select 'duplicate_product' as rule, count(*) as violations from (select product_id from products group by 1 having count(*) > 1)
union all select 'product_without_maker', count(*) from products where maker is null
union all select 'link_without_product', count(*) from links where product_id not in (select product_id from products)
union all select 'code_of_two_products', count(*) from (select code from codes group by code having count(*) > 1)""")
def integrity_violations(spark, d):
    df = table(spark, d, "ndc")
    products = graph.products(df).drop("active_ingredients", "route").distinct()
    none = modeling.violations({"product_without_maker": products.where(F.col("maker").isNull())})
    links = graph.orphans(_recall_links(spark, d), "product_id", products, "product_id", "link_without_product")
    return graph.repeats(products, ["product_id"], "duplicate_product").unionByName(none).unionByName(links).unionByName(graph.repeats(graph.product_codes(df), ["code"], "code_of_two_products"))


@query(f"""with {_IDENT}, {_SHORT}, {_PRODUCTS}, {_INGR}, {_CODES}, {_LINKS}, {_MEMBERS},
apps as (select {_APP.format(c='application_number')} as a from ndc union select {_APP.format(c='application_number')} from drugsfda)
select 'products' as entity, count(*) as n from products union all select 'makers', count(distinct maker) from products union all select 'ingredients', count(distinct ingredient) from ingredients
union all select 'product_ingredients', count(*) from ingredients union all select 'product_codes', count(*) from codes union all select 'applications', count(*) from apps where a is not null
union all select 'routes', count(*) from (select distinct product_id, {N.sql_words('r')} as r from (select product_id, unnest(route) as r from ndc where product_id is not null)) where r is not null
union all select 'packages', count(*) from (select distinct product_id, {N.sql_ndc('p.package_ndc')} as c from (select product_id, unnest(packaging) as p from ndc where product_id is not null)) where c is not null
union all select 'equivalence_members', count(*) from members union all select 'shortage_products', count(*) from resolved where product_id is not null union all select 'recall_products', count(*) from links""")
def graph_tables(spark, d):
    """Rows of each table of the graph after it was written, checked, published and read back."""
    ndc = table(spark, d, "ndc")
    path = scratch(spark, "graph")
    graph.publish(graph.tables(ndc, table(spark, d, "drugsfda"), _resolved(spark, d), _recall_links(spark, d)), path)
    read = graph.read(spark, path)
    parts = [df.agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("n")) for name, df in read.items()]
    return reduce(DataFrame.unionByName, parts)


# Traversal

_STOPPED = f"""stopped as (select product_id, max(s) = 1 as in_shortage, max(r) = 1 as in_recall from (
  select product_id, 1 as s, 0 as r from resolved where lower({N.sql_strip('status')}) = 'current' and product_id is not null
  union all select l.product_id, 0, 1 from links l join {_now('recalls')} using (row_id) where lower({N.sql_strip('status')}) = 'ongoing') group by product_id)"""
_MARKET = f"{_IDENT}, {_SHORT}, {_LINKS}, {_PRODUCTS}, {_INGR}, {_STOPPED}"


def _stopped(spark, d) -> DataFrame:
    """Products under a current shortage or an ongoing recall: rows are filtered first, then resolved, each feed read once."""
    ndc = table(spark, d, "ndc")
    current = _latest(spark, d, "shortages").where(market.has_status("status", "current"))
    ongoing = _latest(spark, d, "recalls").where(market.has_status("status", "ongoing"))
    return market.blocked(resolve.waterfall(current, resolve.shortage_tiers(), resolve.directory_keys(ndc)), resolve.recall_links(ongoing, ndc))


def _market(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    df = table(spark, d, "ndc")
    return graph.products(df).drop("active_ingredients", "route").distinct(), graph.product_ingredients(df), materialise(_stopped(spark, d), "stopped")


@query(f"with {_MARKET} select product_id, in_shortage, in_recall from stopped")
def current_shortages_and_recalls(spark, d):
    return _stopped(spark, d)


@query(f"""with {_MARKET} select ingredient, count(distinct maker) as makers, count(distinct case when s.product_id is null then maker end) as available_makers
from (select distinct product_id, ingredient from ingredients) i join (select * from products where finished) p using (product_id) left join stopped s using (product_id) group by ingredient""")
def available_manufacturers(spark, d):
    products, ingredients, stopped = _market(spark, d)
    return market.available_makers(products, ingredients, stopped)


@query(f"""with {_MARKET}, sets as (select product_id, string_agg(distinct ingredient, '|' order by ingredient) as ingredients from ingredients group by 1),
rows as (select s.product_id, s.ingredients, p.maker, p.finished, in_shortage, in_recall from sets s join products p using (product_id) left join stopped using (product_id))
select product_id, (select count(distinct o.product_id) from rows o where o.ingredients = t.ingredients and o.maker <> t.maker and o.in_recall and o.finished) as recalled_elsewhere from rows t where in_shortage""")
def recall_overlap_setequal(spark, d):
    products, ingredients, stopped = _market(spark, d)
    return market.overlap(products, market.ingredient_sets(ingredients), stopped)


@query(f"""with {_MARKET}, {_MEMBERS} select m.product_id, cast(count(*) as bigint) as candidates, count(*) filter (where s.product_id is null) as available
from members m join members o on m.group_id = o.group_id and m.product_id <> o.product_id left join stopped s on s.product_id = o.product_id group by m.product_id""")
def alternative_availability(spark, d):
    # Members are read three times below; their signatures are worked out once.
    products, _, stopped = _market(spark, d)
    return market.alternatives(materialise(graph.equivalence_members(table(spark, d, "ndc")), "members"), products, stopped)


@query(f"""with {_MARKET} select ingredient, maker, product_id from (select ingredient, maker, product_id, row_number() over (partition by ingredient, maker order by coalesce(in_recall, false) desc, coalesce(in_shortage, false) desc, product_id) as r
from (select distinct product_id, ingredient from ingredients) join products using (product_id) left join stopped using (product_id) where maker is not null) where r = 1""")
def alternative_top_per_manufacturer(spark, d):
    products, ingredients, stopped = _market(spark, d)
    return market.best_per_maker(products, ingredients, stopped)


@query(f"""with {_PRODUCTS}, {_INGR} select distinct product_id from products left join ingredients using (product_id)
where contains(coalesce(generic, ''), 'sodium') or contains(coalesce(brand, ''), 'sodium') or contains(coalesce(ingredient, ''), 'sodium')""")
def drug_search(spark, d):
    df = table(spark, d, "ndc")
    return market.search(graph.products(df), graph.product_ingredients(df), "Sodium")


@query(f"""with {_INGR}, asked as (select unnest(['raulfrouldazine', 'ardevir', 'no such thing']) as q), names as (select distinct ingredient from ingredients),
hit as (select q, count(*) filter (where ingredient = q) as exact, count(*) filter (where contains(ingredient, q)) as part, min(ingredient) filter (where contains(ingredient, q)) as one from asked cross join names group by q)
select q, case when exact > 0 then 'exact' when part = 1 then 'unique' when part > 1 then 'ambiguous' else 'missing' end as outcome, case when exact > 0 then q when part = 1 then one end as ingredient from hit""")
def ingredient_name_lookup(spark, d):
    names = graph.product_ingredients(table(spark, d, "ndc")).select("ingredient").distinct()
    asked = ("raulfrouldazine", "ardevir", "no such thing")
    one = names.agg(*[F.struct(F.lit(q).alias("q"), F.count_if(F.col("ingredient") == q).alias("exact"), F.count_if(F.contains("ingredient", F.lit(q))).alias("part"), F.min(F.when(F.contains("ingredient", F.lit(q)), F.col("ingredient"))).alias("one")).alias(f"q{i}") for i, q in enumerate(asked)])
    rows = one.select(F.explode(F.array(*one.columns)).alias("x")).select("x.*")
    outcome = F.when(F.col("exact") > 0, "exact").when(F.col("part") == 1, "unique").when(F.col("part") > 1, "ambiguous").otherwise("missing")
    return rows.select("q", outcome.alias("outcome"), F.when(F.col("exact") > 0, F.col("q")).when(F.col("part") == 1, F.col("one")).alias("ingredient"))


_NEEDLES = ("sodium", "potassium", "no such thing")
_LIMIT = 25
_ASKED = f"""needles as (select unnest({list(_NEEDLES)}) as q),
found as (select distinct q, p.product_id from needles, (select * from products where finished) p left join ingredients i using (product_id) where contains(coalesce(generic, ''), q) or contains(coalesce(brand, ''), q) or contains(coalesce(ingredient, ''), q)),
matched as (select q, product_id from (select *, row_number() over (partition by q order by product_id) as r from found) where r <= {_LIMIT}),
others as (select distinct w.q, p.product_id, p.maker from (select distinct q, ingredient from matched join ingredients using (product_id)) w join ingredients i using (ingredient) join products p on p.product_id = i.product_id
  where p.finished and p.maker is not null and not exists (select 1 from matched m join products o using (product_id) where m.q = w.q and o.maker = p.maker))"""


@query(f"""with {_MARKET}, {_MEMBERS}, {_ASKED}, c as (select q, count(*) as alternative_products, count(distinct maker) as alternative_makers, count(*) filter (where in_shortage) as in_shortage, count(*) filter (where in_recall) as in_recall from others left join stopped using (product_id) group by q),
e as (select q, count(*) as equivalents from (select distinct m.q, b.product_id from matched m join members a using (product_id) join members b on a.group_id = b.group_id where not exists (select 1 from matched x where x.q = m.q and x.product_id = b.product_id)) group by q)
select q, (select count(*) from matched m where m.q = a.q) as matched, coalesce(alternative_products, 0) as alternative_products, coalesce(alternative_makers, 0) as alternative_makers, coalesce(in_shortage, 0) as in_shortage, coalesce(in_recall, 0) as in_recall, coalesce(equivalents, 0) as equivalents
from needles a left join c using (q) left join e using (q)""")
def drug_report(spark, d):
    products, ingredients, stopped = _market(spark, d)
    needles = spark.createDataFrame([(q,) for q in _NEEDLES], "q string")
    return market.drug_report(needles, products, ingredients, stopped, materialise(graph.equivalence_members(table(spark, d, "ndc")), "members"), _LIMIT)


@query(f"""with {_MARKET}, {_ASKED}, one as (select q, maker, product_id, coalesce(in_recall, false) as r, coalesce(in_shortage, false) as s, row_number() over (partition by q, maker order by coalesce(in_recall, false) desc, coalesce(in_shortage, false) desc, product_id) as k from others left join stopped using (product_id))
select q, place, product_id, maker from (select *, cast(row_number() over (partition by q order by r desc, s desc, product_id) as int) as place from one where k = 1) where place <= {_LIMIT}""")
def drug_alternatives(spark, d):
    products, ingredients, stopped = _market(spark, d)
    return market.drug_alternatives(spark.createDataFrame([(q,) for q in _NEEDLES], "q string"), products, ingredients, stopped, _LIMIT)


_DAY = SQL["multi_format_dates"].split("select row_id, ")[1].split(" as day")[0]


@query(f"""select row_id, coalesce(lower({N.sql_strip('status')}) = 'current', false) as ongoing, cast(greatest(0, date_diff('day', {_DAY}, case when lower({N.sql_strip('status')}) = 'current' then date '{AS_OF}' else {_DAY.replace('initial_posting_date', 'update_date')} end)) as bigint) as days
from shortages""".replace("greatest(0, date_diff", "(select case when x is null then null else greatest(0, x) end from (select date_diff").replace("end)) as bigint)", "end) as x)) as bigint)"))
def shortage_duration(spark, d):
    return market.durations(table(spark, d, "shortages"), AS_OF, N.feed_date(F.col("initial_posting_date")), N.feed_date(F.col("update_date")))


@query(f"""select generic, maker, arg_min(row_id, -len(coalesce(shortage_reason, '')) * 1000000000000 + row_id) as representative, count(*) as rows from
(select {N.sql_words('generic_name')} as generic, coalesce({N.sql_manufacturer('company_name')}, {N.sql_words('company_name')}) as maker, row_id, shortage_reason from {_now('shortages')}) group by generic, maker""")
def dashboard_groups(spark, d):
    rows = _latest(spark, d, "shortages").select(N.words(F.col("generic_name")).alias("generic"), N.display_key(F.col("company_name")).alias("maker"), "row_id", "shortage_reason")
    return market.rank_groups(rows, ["generic", "maker"], F.length(F.coalesce("shortage_reason", F.lit(""))), "row_id")


# Differences by the feeds' own identity

_IDENTITY = ("package_ndc", "initial_posting_date", "presentation")
_PAIR = """names as (select distinct snapshot, dense_rank() over (order by snapshot desc) as r from shortages),
side as (select n.r, coalesce(package_ndc, '') as a, coalesce(initial_posting_date, '') as b, coalesce(presentation, '') as c, arg_max({'s': status, 'r': shortage_reason, 'v': availability}, {'i': ingested_at, 'x': row_id}) as x
  from shortages join names n using (snapshot) where n.r <= 2 group by all),
joined as (select coalesce(o.a, n.a) as a, coalesce(o.b, n.b) as b, coalesce(o.c, n.c) as c, o.x as o, n.x as n, o.a is not null as old, n.a is not null as new from (select * from side where r = 2) o full join (select * from side where r = 1) n on o.a = n.a and o.b = n.b and o.c = n.c)"""


def _sides(spark, d) -> DataFrame:
    df = table(spark, d, "shortages")
    last = sorted(r[0] for r in df.select("snapshot").where(F.col("snapshot").isNotNull()).distinct().collect())[-2:]
    keys = [F.coalesce(c, F.lit("")).alias(k) for c, k in zip(_IDENTITY, "abc")]
    value = F.max_by(F.struct(F.col("status").alias("s"), F.col("shortage_reason").alias("r"), F.col("availability").alias("v")), F.struct("ingested_at", "row_id"))
    old, new = (df.where(F.col("snapshot") == s).groupBy(*keys).agg(value.alias(x)) for s, x in zip(last, ("o", "n")))
    return old.withColumn("old", F.lit(True)).join(new.withColumn("new", F.lit(True)), list("abc"), "full_outer")


@query(f"""with {_PAIR} select a as package_ndc, b as initial_posting_date, c as presentation, case when not old then 'new' when not new then 'removed' else 'status_changed' end as kind from joined
where not old or not new or o.s is distinct from n.s""")
def snapshot_diff(spark, d):
    kind = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").otherwise("status_changed")
    keep = F.col("old").isNull() | F.col("new").isNull() | ~F.col("o.s").eqNullSafe(F.col("n.s"))
    return _sides(spark, d).where(keep).select(F.col("a").alias("package_ndc"), F.col("b").alias("initial_posting_date"), F.col("c").alias("presentation"), kind.alias("kind"))


@query(f"""with {_PAIR} select a as package_ndc, b as initial_posting_date, c as presentation, field, before, after from (select a, b, c, 'shortage_reason' as field, o.r as before, n.r as after from joined where old and new
union all select a, b, c, 'availability', o.v, n.v from joined where old and new) where before is distinct from after""")
def snapshot_diff_fields(spark, d):
    both = _sides(spark, d).where("old and new")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"o.{x}").alias("before"), F.col(f"n.{x}").alias("after")) for f, x in (("shortage_reason", "r"), ("availability", "v"))])
    rows = both.select(F.col("a").alias("package_ndc"), F.col("b").alias("initial_posting_date"), F.col("c").alias("presentation"), F.explode(fields).alias("f")).select("package_ndc", "initial_posting_date", "presentation", "f.*")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


@query(f"""with {_PAIR} select count(*) filter (where not old) as new_records, count(*) filter (where not new) as removed, count(*) filter (where old and new and o.s is distinct from n.s) as status_changed,
count(*) filter (where old and new and (o.r is distinct from n.r or o.v is distinct from n.v)) as fields_changed from joined""")
def snapshot_diff_summary(spark, d):
    both = F.col("old").isNotNull() & F.col("new").isNotNull()
    differs = lambda x: ~F.col(f"o.{x}").eqNullSafe(F.col(f"n.{x}"))
    return _sides(spark, d).agg(F.count_if(F.col("old").isNull()).alias("new_records"), F.count_if(F.col("new").isNull()).alias("removed"), F.count_if(both & differs("s")).alias("status_changed"), F.count_if(both & (differs("r") | differs("v"))).alias("fields_changed"))


@query(f"""with {_MARKET}, {_CODES}, c as (select ingredient, count(distinct case when in_recall then product_id end) as recalled, count(distinct case when in_shortage then product_id end) as short, count(distinct maker) as makers
  from (select distinct product_id, ingredient from ingredients) join products using (product_id) left join stopped using (product_id) group by ingredient)
select ingredient, 100 * recalled + 10 * short + makers as score from c order by score desc, ingredient limit 3""")
def worked_examples(spark, d):
    """The three ingredients with most to show, a report by definition."""
    products, ingredients, stopped = _market(spark, d)
    rows = ingredients.select("product_id", "ingredient").distinct().join(products.select("product_id", "maker"), "product_id").join(stopped, "product_id", "left")
    n = lambda c: F.countDistinct(F.when(F.col(c), F.col("product_id")))
    score = (100 * n("in_recall") + 10 * n("in_shortage") + F.countDistinct("maker")).alias("score")
    return rows.groupBy("ingredient").agg(score).orderBy(F.desc("score"), "ingredient").limit(3)


@query(f"""with g as (select lower({N.sql_words('generic_name')}) as drug, coalesce({N.sql_manufacturer('company_name')}, {N.sql_words('company_name')}) as maker, package_ndc, status from {_now('shortages')})
select drug, count(distinct maker) as makers, count(*) as signals, count(distinct package_ndc) as packages, count(distinct case when lower({N.sql_strip('status')}) = 'current' then maker end) as makers_current from g group by drug""")
def related_counts(spark, d):
    rows = _latest(spark, d, "shortages").select(N.words(F.col("generic_name")).alias("drug"), N.display_key(F.col("company_name")).alias("maker"), "package_ndc", "status")
    current = F.when(market.has_status("status", "current"), F.col("maker"))
    return rows.groupBy("drug").agg(F.countDistinct("maker").alias("makers"), F.count(F.lit(1)).alias("signals"), F.countDistinct("package_ndc").alias("packages"), F.countDistinct(current).alias("makers_current"))
