"""Relational knowledge graph of the feeds: dimensions, edges, equivalence groups, checks."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apothecary.functions.names import display_key, normalize_application, normalize_strength, words
from apothecary.functions.text import normalize_ndc
from apothecary.operators import ranges
from apothecary.session import discard, file_system


def surrogate(names: DataFrame, name: str, key: str) -> DataFrame:
    """Dense ids in name order. Ranges are ranked apart and offset by their totals, so no task sorts all names."""
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    return ranges.numbered(distinct, [], [F.col(name)], key).select(key, name)


def display_names(df: DataFrame, raw: str, pos: Column) -> DataFrame:
    """norm, name, spellings: the most frequent spelling a normal form, first seen on ties."""
    each = df.select(display_key(F.col(raw)).alias("norm"), F.col(raw).alias("name"), pos.alias("pos")).where(F.col("norm").isNotNull())
    counted = each.groupBy("norm", "name").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("norm").agg(F.min_by("name", F.struct((-F.col("n")).alias("n"), "first", "name")).alias("name"), F.count(F.lit(1)).alias("spellings"))


def products(ndc: DataFrame) -> DataFrame:
    """One row a product with its normal names; the first of several by content."""
    cols = ["product_id", "product_ndc", "finished", "dosage_form", words(F.col("generic_name")).alias("generic"), words(F.col("brand_name")).alias("brand"), display_key(F.col("labeler_name")).alias("maker"), normalize_application(F.col("application_number")).alias("application"), "active_ingredients", "route"]
    return ndc.where(F.col("product_id").isNotNull()).select(*cols).distinct()


def product_codes(ndc: DataFrame) -> DataFrame:
    """product_id, code, kind: product code and package codes; a code that is both counts as product."""
    own = ndc.select("product_id", F.substring(normalize_ndc(F.col("product_ndc")), 1, 9).alias("code"), F.lit(0).alias("k"))
    packs = ndc.select("product_id", F.explode("packaging").alias("p")).select("product_id", normalize_ndc(F.col("p.package_ndc")).alias("code"), F.lit(1).alias("k"))
    both = own.unionByName(packs).where(F.col("code").isNotNull())
    return both.groupBy("product_id", "code").agg(F.when(F.min("k") == 0, "product").otherwise("package").alias("kind"))


def product_ingredients(ndc: DataFrame) -> DataFrame:
    """product_id, ingredient, strength (both in normal form), each once."""
    each = ndc.select("product_id", F.explode("active_ingredients").alias("a"))
    return each.select("product_id", words(F.col("a.name")).alias("ingredient"), F.coalesce(normalize_strength(F.col("a.strength")), F.lit("")).alias("strength")).where(F.col("ingredient").isNotNull()).distinct()


def signature() -> Column:
    """Canonical text of ingredients with strengths, form and routes; NULL unless all are complete."""
    full = F.size("active_ingredients") > 0
    full = full & F.forall("active_ingredients", lambda a: F.coalesce(words(a["name"]).isNotNull() & normalize_strength(a["strength"]).isNotNull(), F.lit(False)))
    parts = F.array_sort(F.transform("active_ingredients", lambda a: F.concat_ws("@", words(a["name"]), normalize_strength(a["strength"]))))
    routes = F.array_sort(F.filter(F.transform("route", words), lambda r: r.isNotNull()))
    form = words(F.col("dosage_form"))
    return F.when(full & form.isNotNull() & (F.size(routes) > 0), F.concat_ws("#", F.array_join(parts, "|"), form, F.array_join(routes, "|")))


def equivalence_members(ndc: DataFrame) -> DataFrame:
    """group_id, product_id of finished products whose signature at least two share.

    Group sizes are counted first and joined back, so no group is gathered anywhere.
    """
    each = ndc.where("finished").select("product_id", signature().alias("signature")).where(F.col("signature").isNotNull()).distinct()
    sizes = each.groupBy("signature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return each.join(sizes, "signature").select(F.substring(F.sha2("signature", 256), 1, 24).alias("group_id"), "product_id")


def equivalence_counts(members: DataFrame) -> DataFrame:
    """Groups, members and directed pairs in closed form, without building the pairs."""
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0)).alias("pairs"))


def sponsors(drugsfda: DataFrame, ndc: DataFrame) -> DataFrame:
    """application, sponsor: numbers of both feeds; the sponsor feed wins, greatest name on repeats."""
    told = drugsfda.select(normalize_application(F.col("application_number")).alias("application"), display_key(F.col("sponsor_name")).alias("s")).where(F.col("application").isNotNull())
    told = told.groupBy("application").agg(F.max("s").alias("sponsor"))
    used = ndc.select(normalize_application(F.col("application_number")).alias("application")).where(F.col("application").isNotNull()).distinct()
    return used.join(told, "application", "full_outer").select("application", "sponsor")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str, rule: str) -> DataFrame:
    """rule, violations: rows of ``child`` whose reference leads nowhere; NULL refers to nothing and is fine."""
    bad = child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")
    return bad.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


def repeats(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """rule, violations: keys that occur more than once."""
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return many.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("violations"))


TABLES = ("products", "makers", "ingredients", "product_ingredients", "product_codes", "packages", "routes", "applications", "equivalence_members", "shortage_products", "recall_products")


def tables(ndc: DataFrame, drugsfda: DataFrame, resolved: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """All tables of the graph by name: nodes and edges of the directory, and the edges of both feeds."""
    made = products(ndc)
    pairs = product_ingredients(ndc)
    named = ndc.where(F.col("product_id").isNotNull())
    packs = named.select("product_id", F.explode("packaging").alias("p")).select("product_id", normalize_ndc(F.col("p.package_ndc")).alias("code"), "p.description", "p.sample").where(F.col("code").isNotNull())
    return {
        "products": made.drop("active_ingredients", "route").distinct(),
        "makers": surrogate(made.select("maker"), "maker", "maker_id"),
        "ingredients": surrogate(pairs.select("ingredient"), "ingredient", "ingredient_id"),
        "product_ingredients": pairs,
        "product_codes": product_codes(ndc),
        # Of several descriptions of a package the first by bytes stays.
        "packages": packs.groupBy("product_id", "code").agg(F.min("description").alias("description"), F.max("sample").alias("sample")),
        "routes": _routes(named),
        "applications": sponsors(drugsfda, ndc),
        "equivalence_members": equivalence_members(ndc),
        "shortage_products": resolved.where(F.col("product_id").isNotNull()).select("row_id", "product_id", "method"),
        "recall_products": links,
    }


def _routes(named: DataFrame) -> DataFrame:
    each = named.select("product_id", F.explode("route").alias("r")).select("product_id", words(F.col("r")).alias("route"))
    return each.where(F.col("route").isNotNull()).distinct()


def publish(graph: dict[str, DataFrame], path: str) -> None:
    """Write all tables beside ``path``, check the references between them, and put them in place in one step.

    A broken reference or a table that is there already publishes nothing and leaves nothing behind.
    """
    spark = next(iter(graph.values())).sparkSession
    fs, target = file_system(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    held = f"{target.getParent()}/.{target.getName()}-{uuid.uuid4().hex}"
    try:
        for name, df in graph.items():
            df.write.parquet(f"{held}/{name}")
        written = {name: spark.read.schema(df.schema).parquet(f"{held}/{name}") for name, df in graph.items()}
        checks = [orphans(written[t], "product_id", written["products"], "product_id", t) for t in ("product_ingredients", "packages", "routes", "equivalence_members")]
        checks.append(orphans(written["product_ingredients"], "ingredient", written["ingredients"], "ingredient", "ingredient"))
        broken = [tuple(r) for r in reduce(DataFrame.unionByName, checks).where("violations > 0").collect()]
        if broken:
            raise ValueError(f"references that lead nowhere: {broken}")
        fs.mkdirs(target.getParent())
        if not fs.rename(file_system(spark, held)[1], target):
            raise FileExistsError(path)
    except BaseException:
        discard(spark, held)
        raise


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a published graph; what was not published is an error."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}
