"""Entity resolution by prioritised keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apothecary.functions.names import normalize_application, normalize_manufacturer, product_of_package, words
from apothecary.functions.text import normalize_ndc

TEXT_CODE = r"(?i)\b(?:NDC\s*[:#]?\s*)?(\d{4,5}-\d{3,4}-\d{1,2})\b"


def directory_keys(ndc: DataFrame) -> DataFrame:
    """kind (package or product), code, and the identity each code leads to."""
    fields = {
        "brand": F.coalesce(F.col("brand_name"), F.lit("")),
        "n_ingredients": F.coalesce(F.size("active_ingredients"), F.lit(0)),
        "product_id": F.coalesce("product_id", F.lit("")),
        "generic": words(F.col("generic_name")),
        "maker": normalize_manufacturer(F.col("labeler_name")),
    }
    # Names are stated: aliases inside a struct are lost where it also holds functions of elements.
    identity = F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    product = ndc.select(F.lit("product").alias("kind"), product_of_package(F.col("product_ndc")).alias("code"), identity.alias("identity"))
    package = ndc.select(F.explode("packaging").alias("p"), identity.alias("identity")).select(F.lit("package").alias("kind"), normalize_ndc(F.col("p.package_ndc")).alias("code"), "identity")
    return product.unionByName(package).where(F.col("code").isNotNull())


def choose(keys: DataFrame) -> DataFrame:
    """One row a key: the agreed identity, or none where identities disagree on name or maker.

    Counts combine on the map side, so a code with very many entries is no burden.
    """
    fp = F.struct("identity.generic", "identity.maker")
    rank = F.struct((F.col("identity.brand") != "").alias("b"), F.col("identity.n_ingredients").alias("n"), F.col("identity.product_id").alias("p"))
    out = keys.groupBy("kind", "code").agg(F.count(F.lit(1)).alias("candidates"), F.min(fp).alias("lo"), F.max(fp).alias("hi"), F.max_by("identity", rank).alias("best"))
    agreed = F.to_json("lo") == F.to_json("hi")
    return out.select("kind", "code", "candidates", agreed.alias("agreed"), F.when(agreed, F.col("best.product_id")).alias("product_id"))


def waterfall(rows: DataFrame, tiers: list[tuple[str, str, Column]], keys: DataFrame) -> DataFrame:
    """row_id, method, code, candidates, product_id of the first key that the directory holds.

    ``tiers`` are (method, kind, array of codes) in order; the search ends at the first code
    that is present, even where it is ambiguous. Rows without any have method ``unmatched``.
    """
    def tagged(tier: int, method: str, kind: str, codes: Column) -> Column:
        place = lambda c, i: F.struct(F.lit(tier).alias("tier"), i.alias("pos"), F.lit(method).alias("method"), F.lit(kind).alias("kind"), c.alias("code"))
        return F.transform(F.coalesce(codes, F.array().cast("array<string>")), place)

    arrays = [tagged(n, *tier) for n, tier in enumerate(tiers)]
    asked = rows.select("row_id", F.explode(F.concat(*arrays)).alias("a")).select("row_id", "a.*").where(F.col("code").isNotNull())
    hit = asked.join(choose(keys), ["kind", "code"])
    first = hit.groupBy("row_id").agg(F.min_by(F.struct("method", "code", "candidates", "agreed", "product_id"), F.struct("tier", "pos")).alias("h"))
    method = F.when(F.col("h").isNull(), "unmatched").when(F.col("h.agreed"), F.col("h.method")).otherwise(F.concat(F.lit("ambiguous_"), F.col("h.method")))
    return rows.select("row_id").join(first, "row_id", "left").select("row_id", method.alias("method"), F.col("h.code").alias("code"), F.coalesce("h.candidates", F.lit(0)).cast("bigint").alias("candidates"), "h.product_id")


def shortage_tiers() -> list[tuple[str, str, Column]]:
    own = F.col("package_ndc")
    listed = lambda c: F.transform(F.col(c), lambda x: normalize_ndc(x))
    return [
        ("package_ndc", "package", F.array(normalize_ndc(own))),
        ("product_ndc", "product", F.array(product_of_package(own))),
        ("openfda_package_ndc", "package", listed("openfda.package_ndc")),
        ("openfda_product_ndc", "product", listed("openfda.product_ndc")),
    ]


def recall_links(recalls: DataFrame, ndc: DataFrame) -> DataFrame:
    """row_id, product_id, method: products of the first tier that yields any product.

    Tiers: listed codes, then codes in the text, then application numbers. Within a tier
    a product keeps its first method.
    """
    keys = directory_keys(ndc).select("kind", "code", F.col("identity.product_id").alias("product_id")).distinct()
    both = keys.select("code", "product_id").distinct()
    texts = F.concat_ws(" ", "product_description", "code_info", "more_code_info")
    parts = [
        (1, 1, "openfda_package_ndc", F.transform("openfda.package_ndc", normalize_ndc)),
        (1, 2, "openfda_product_ndc", F.transform("openfda.product_ndc", normalize_ndc)),
        (2, 3, "explicit_ndc_text", F.transform(F.regexp_extract_all(texts, F.lit(TEXT_CODE), F.lit(1)), normalize_ndc)),
    ]
    exploded = [recalls.select("row_id", F.lit(t).alias("tier"), F.lit(p).alias("priority"), F.lit(m).alias("method"), F.explode(a).alias("code")) for t, p, m, a in parts]
    by_code = reduce(DataFrame.unionByName, exploded).where(F.col("code").isNotNull()).distinct().join(both, "code").drop("code")
    apps = recalls.select("row_id", F.lit(3).alias("tier"), F.lit(4).alias("priority"), F.lit("application_number").alias("method"), F.explode(F.transform("openfda.application_number", normalize_application)).alias("app"))
    of_app = ndc.select(normalize_application(F.col("application_number")).alias("app"), "product_id").where(F.col("app").isNotNull()).distinct()
    every = by_code.unionByName(apps.where(F.col("app").isNotNull()).distinct().join(of_app, "app").drop("app"))
    per = every.groupBy("row_id", "tier", "product_id").agg(F.min_by("method", "priority").alias("method"))
    first = Window.partitionBy("row_id")
    return per.withColumn("best", F.min("tier").over(first)).where(F.col("tier") == F.col("best")).select("row_id", "product_id", "method")
