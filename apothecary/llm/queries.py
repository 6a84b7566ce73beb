"""Queries of the problems on language data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.llm import collapse as _collapse
from apothecary.llm import components as _components
from apothecary.llm import languages as _languages
from apothecary.llm import leakage as _leakage
from apothecary.llm import matching as _matching
from apothecary.llm import overlap as _overlap
from apothecary.llm import tokens as _tokens
from apothecary.session import materialise, spread
from apothecary.sources.tables import table

SHARES = {"train": 0.70, "validation": 0.15, "test": 0.15}
TIES = ("incident_id", "split_group_id")


def _documents(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", *columns))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "phase12_examples")
    sets = _components.components(_components.ties(df, "candidate_id", TIES))
    other = (F.col("node") != F.col("label")) & ~F.col("node").startswith(_components.NAMELESS)
    return sets.where(other).select(F.col("label").alias("first_id"), F.col("node").alias("candidate_id"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return _components.assign(table(spark, d, "phase12_examples"), "candidate_id", TIES, F.col("event.primary_cause"), SHARES)


def p1_split_checks(spark: SparkSession, d: str) -> DataFrame:
    """What the assignment must not do, with how often it does it: none expected."""
    df = table(spark, d, "phase12_examples")
    assigned = materialise(p1_splits(spark, d), "split-checks")
    return _components.checks(df, assigned, "candidate_id", TIES, F.col("event.primary_cause"), SHARES)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlap.record_pairs(table(spark, d, "phase11_examples"))


def p3_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return _overlap.overlaps(table(spark, d, "phase11_examples"))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _overlap.coverage(table(spark, d, "phase11_examples"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return _overlap.report(table(spark, d, "phase11_examples"))


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every best match with its score and confidence."""
    return _matching.match(table(spark, d, "recalls"), table(spark, d, "shortages"), table(spark, d, "ndc"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_matches(spark, d).where(F.col("confidence") >= _matching.ACCEPT).select("feed", "record_key", "product_ndc")


def _reasons(spark: SparkSession, d: str) -> DataFrame:
    recalls, examples = table(spark, d, "recalls"), table(spark, d, "phase12_examples")
    latest = recalls.agg(F.max("snapshot")).first()[0]
    # Numbers sort as text once they are padded, so one column serves both kinds of id.
    own = recalls.where(F.col("snapshot") == latest).select(F.lit("recalls").alias("feed"), F.lpad(F.col("row_id").cast("string"), 20, "0").alias("id"), F.col("reason_for_recall").alias("text"))
    return own.unionByName(examples.select(F.lit("phase12_examples").alias("feed"), F.col("candidate_id").alias("id"), F.col("raw_text").alias("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    kept = F.when(F.col("feed") == "recalls", F.col("kept").cast("bigint").cast("string")).otherwise(F.col("kept"))
    return _collapse.collapse(_reasons(spark, d)).where(F.col("copies") > 1).select("feed", kept.alias("kept"), "copies")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return _tokens.encode(_documents(spark, d), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose ids do not decode to the very text, NULL read as empty; none are expected."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("was"))
    back = _tokens.decode(_tokens.encode(docs, "doc_id", "was"), "doc_id")
    return docs.join(back, "doc_id").where(F.col("was") != F.col("text")).select("doc_id")


def p8_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _tokens.encode_offsets(_documents(spark, d), "doc_id", "text")


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """Characters of each document that its tokens cover: all of them, in code points."""
    return _tokens.covered(p8_offsets(spark, d), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leakage.find(_documents(spark, d), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 20 words up to 2 word edits apart, found with a target recall of 0.95."""
    return _leakage.find(_documents(spark, d), table(spark, d, "eval_items"), window=20, edits=2)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _languages.find(_documents(spark, d, "lang")).where(F.col("lang").isNotNull()).select("doc_id", "seg", "lang")


def p10_confidence(spark: SparkSession, d: str) -> DataFrame:
    """The same with confidences, and rejected texts with a NULL language."""
    return _languages.find(_documents(spark, d, "lang"))


_ALL = (p1_found, p1_splits, p1_split_checks, p3_found, p3_overlaps, p3_coverage, p3_report, p5_found, p5_matches, p6_found, p8_ids, p8_roundtrip, p8_offsets, p8_cover, p9_found, p9_near, p10_found, p10_confidence)
QUERIES = {f.__name__: f for f in _ALL}

_WS = r"\s"
_TIED = rf"""with recursive e as (select distinct candidate_id as node, x as entity from (select candidate_id, unnest([nullif('i:' || lower(regexp_replace(incident_id, '{_WS}', '', 'g')), 'i:'),
  nullif('g:' || lower(regexp_replace(split_group_id, '{_WS}', '', 'g')), 'g:')]) as x from phase12_examples) where x is not null),
reach(node, other) as (select node, node from e union select r.node, b.node from reach r join e a on a.node = r.other join e b on b.entity = a.entity)
select first_id, candidate_id from (select node as candidate_id, min(other) as first_id from reach group by node) where first_id <> candidate_id"""

_WORDS_OF_RECORDS = r"""r as (select distinct candidate_id, split, source, split = 'train' as train, regexp_extract_all(lower(strip_accents(raw_text)), '[a-z0-9]+') as l, list_distinct(regexp_extract_all(lower(strip_accents(raw_text)), '[a-z0-9]+')) as w from phase11_examples
  where split in ('train', 'validation', 'test', 'gold_evaluation') and trim(raw_text) <> '' and lower(trim(raw_text)) <> '[fda reason missing]')"""

_OVERLAPS = rf"""with {_WORDS_OF_RECORDS},
x as (select candidate_id, train, len(w) as n, unnest(w) as word from (select distinct candidate_id, train, list_sort(w) as w from r)),
p as (select t.candidate_id as a, e.candidate_id as b, t.n as n, e.n as m, count(*) as shared from x t join x e on t.word = e.word where t.train and not e.train group by all)
select distinct least(a, b) as id_a, greatest(a, b) as id_b from p where a <> b and 4 * shared >= 3 * (n + m - shared)"""

_OVERLAP_RECORDS = rf"""with {_WORDS_OF_RECORDS}, c as (select md5(array_to_string(l, ' ')) as class, any_value(w) as w, bool_or(train) as t, bool_or(not train) as e from r where len(l) > 0 group by 1),
x as (select class, t, e, len(w) as n, unnest(w) as word from c),
p as (select a.class as train, b.class as eval, a.n as n, b.n as m, count(*) as shared from x a join x b on a.word = b.word where a.t and b.e group by all),
best as (select eval as class, count(*) as train_classes, max(round(shared / (n + m - shared), 4)) as similarity from p where 4 * shared >= 3 * (n + m - shared) group by eval)
select distinct candidate_id, split, source, class, train_classes, similarity from (select candidate_id, split, source, md5(array_to_string(l, ' ')) as class from r where not train and len(l) > 0) join best using (class)"""

_COPIES = r"""with t as (select 'recalls' as feed, lpad(row_id::varchar, 20, '0') as id, reason_for_recall as text from recalls where snapshot = (select max(snapshot) from recalls)
  union all select 'phase12_examples', candidate_id, raw_text from phase12_examples),
k as (select feed, id, array_to_string(list_sort(list_filter(list_transform(string_split(lower(text), ';'), lambda p: regexp_replace(p, '[^\p{L}\p{Nd}]+', '', 'g')), lambda p: p <> '')), ';') as key
  from t where regexp_replace(text, '\s+', '', 'g') <> '')
select feed, case when feed = 'recalls' then min(id)::bigint::varchar else min(id) end as kept, count(*) as copies from k group by feed, key having count(*) > 1"""

_LEAKS = r"""with d as (select doc_id, regexp_extract_all(regexp_replace(lower(text), '([a-z0-9])-[ \t]*\r?\n[ \t]*([a-z0-9])', '\1\2', 'g'), '[a-z0-9]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(regexp_replace(lower(text), '([a-z0-9])-[ \t]*\r?\n[ \t]*([a-z0-9])', '\1\2', 'g'), '[a-z0-9]+') as w from eval_items where text is not null),
dg as (select distinct doc_id, array_to_string(w[p:p + 13], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 12)) as p from d)),
ig as (select distinct item_id, array_to_string(w[p:p + 13], ' ') as g from (select item_id, w, unnest(range(1, len(w) - 12)) as p from i))
select distinct doc_id, item_id from dg join ig using (g)"""

_NO_VIOLATIONS = "select unnest(['set_in_two_splits', 'record_in_two_splits', 'record_without_split', 'label_off_its_share']) as rule, 0::bigint as violations"

SQL: dict[str, str] = {"p8_cover": "select doc_id, coalesce(length(text), 0)::bigint as chars from documents", "p1_found": _TIED, "p1_split_checks": _NO_VIOLATIONS, "p3_found": _OVERLAPS, "p3_overlaps": _OVERLAP_RECORDS, "p6_found": _COPIES, "p9_found": _LEAKS}
