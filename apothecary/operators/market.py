"""Who else makes it, and is it available: traversals over graph edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apothecary.functions.text import strip


def has_status(c: Column | str, status: str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(strip(c)) == status, F.lit(False))


def blocked(shortage_edges: DataFrame, recall_edges: DataFrame) -> DataFrame:
    """product_id, in_shortage, in_recall of products under a current shortage or an ongoing recall."""
    both = shortage_edges.select("product_id", F.lit(1).alias("s"), F.lit(0).alias("r")).unionByName(recall_edges.select("product_id", F.lit(0).alias("s"), F.lit(1).alias("r")))
    return both.where(F.col("product_id").isNotNull()).groupBy("product_id").agg((F.max("s") == 1).alias("in_shortage"), (F.max("r") == 1).alias("in_recall"))


def available_makers(products: DataFrame, ingredients: DataFrame, stopped: DataFrame) -> DataFrame:
    """ingredient, makers, available_makers over finished products; ingredients without any available maker stay with 0."""
    rows = ingredients.select("product_id", "ingredient").distinct().join(products.where("finished").select("product_id", "maker"), "product_id").join(stopped.select("product_id", F.lit(True).alias("stopped")), "product_id", "left")
    each = rows.groupBy("ingredient", "maker").agg(F.max(F.col("stopped").isNull()).alias("free"))
    return each.groupBy("ingredient").agg(F.count("maker").alias("makers"), F.count(F.when(F.col("free"), F.col("maker"))).alias("available_makers"))


def ingredient_sets(ingredients: DataFrame) -> DataFrame:
    """product_id, ingredients: the sorted set, so equal sets join by equality instead of by relational division."""
    return ingredients.groupBy("product_id").agg(F.array_join(F.sort_array(F.collect_set("ingredient")), "|").alias("ingredients"))


def overlap(products: DataFrame, sets: DataFrame, stopped: DataFrame) -> DataFrame:
    """product_id, recalled_elsewhere: finished products of other makers with the same ingredient set under recall, for products in shortage."""
    rows = sets.join(products.select("product_id", "maker", "finished"), "product_id").join(stopped, "product_id", "left")
    recalled = rows.where(F.col("in_recall") & F.col("finished")).groupBy("ingredients", "maker").agg(F.countDistinct("product_id").alias("n"))
    total = recalled.groupBy("ingredients").agg(F.sum("n").alias("all"))
    target = rows.where(F.col("in_shortage")).select("product_id", "maker", "ingredients")
    out = target.join(total, "ingredients", "left").join(recalled, ["ingredients", "maker"], "left")
    return out.select("product_id", (F.coalesce("all", F.lit(0)) - F.coalesce("n", F.lit(0))).cast("bigint").alias("recalled_elsewhere"))


def alternatives(members: DataFrame, products: DataFrame, stopped: DataFrame) -> DataFrame:
    """product_id, candidates, available: other members of the product's groups, counted without pairing them.

    A group's totals minus the product itself give its candidates; no pair is built.
    """
    state = members.join(stopped.select("product_id", F.lit(1).alias("stop")), "product_id", "left").withColumn("free", F.when(F.col("stop").isNull(), 1).otherwise(0))
    totals = state.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum("free").alias("f"))
    return state.join(totals, "group_id").groupBy("product_id").agg(F.sum(F.col("n") - 1).alias("candidates"), F.sum(F.col("f") - F.col("free")).cast("bigint").alias("available"))


def best_per_maker(products: DataFrame, ingredients: DataFrame, stopped: DataFrame) -> DataFrame:
    """ingredient, maker, product_id: one product a maker and ingredient; recalled first, then in shortage, then by id."""
    rows = ingredients.select("product_id", "ingredient").distinct().join(products.select("product_id", "maker"), "product_id").join(stopped, "product_id", "left")
    order = F.struct((~F.coalesce("in_recall", F.lit(False))).alias("r"), (~F.coalesce("in_shortage", F.lit(False))).alias("s"), F.col("product_id").alias("p"))
    return rows.where(F.col("maker").isNotNull()).groupBy("ingredient", "maker").agg(F.min_by("product_id", order).alias("product_id"))


def search(products: DataFrame, ingredients: DataFrame, needle: str) -> DataFrame:
    """product_id of products whose generic, brand or an ingredient name contains ``needle`` literally."""
    text = needle.lower()
    named = products.where(F.contains(F.coalesce("generic", F.lit("")), F.lit(text)) | F.contains(F.coalesce("brand", F.lit("")), F.lit(text))).select("product_id")
    return named.unionByName(ingredients.where(F.contains("ingredient", F.lit(text))).select("product_id")).distinct()


def durations(shortages: DataFrame, as_of: str, initial: Column, update: Column) -> DataFrame:
    """row_id, ongoing, days: from the first posting to ``as_of`` or to the last update, never below zero; NULL without dates."""
    ongoing = has_status("status", "current")
    end = F.when(ongoing, F.lit(as_of).cast("date")).otherwise(update)
    days = F.datediff(end, initial)
    return shortages.select("row_id", ongoing.alias("ongoing"), F.when(days.isNotNull(), F.greatest(F.lit(0), days)).cast("bigint").alias("days"))


def rank_groups(rows: DataFrame, group: list[str], score: Column, row_id: str) -> DataFrame:
    """One representative a group, the highest score and then the smallest id, with the group's size."""
    return rows.groupBy(*group).agg(F.min_by(row_id, F.struct((-score).alias("s"), F.col(row_id).alias("i"))).alias("representative"), F.count(F.lit(1)).alias("rows"))


def matching(products: DataFrame, ingredients: DataFrame, needles: DataFrame, limit: int) -> DataFrame:
    """q, product_id: for each needle its first ``limit`` finished products by id whose generic, brand or an ingredient holds it.

    The needles are a stated, small set; each product is compared with them once.
    """
    asked = [r["q"] for r in needles.collect()]
    names = products.where("finished").select("product_id", F.array(F.coalesce("generic", F.lit("")), F.coalesce("brand", F.lit(""))).alias("n"))
    parts = ingredients.join(products.where("finished").select("product_id"), "product_id", "left_semi").select("product_id", F.array("ingredient").alias("n"))
    held = lambda q: F.exists("n", lambda x: F.contains(x, F.lit(q.strip().lower())))
    found = names.unionByName(parts).select("product_id", F.explode(F.filter(F.array(*[F.when(held(q), F.lit(q)) for q in asked]), lambda x: x.isNotNull())).alias("q")).distinct()
    return found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("product_id"))).where(F.col("r") <= limit).select("q", "product_id")


def other_makers(matched: DataFrame, products: DataFrame, ingredients: DataFrame) -> DataFrame:
    """q, product_id, maker: finished products of other makers that share an ingredient with a needle's products."""
    pairs = ingredients.select("product_id", "ingredient").distinct()
    wanted = matched.join(pairs, "product_id").select("q", "ingredient").distinct()
    own = matched.join(products.select("product_id", "maker"), "product_id").select("q", "maker").distinct()
    found = pairs.join(F.broadcast(wanted), "ingredient").select("q", "product_id").distinct().join(products.where(F.col("finished") & F.col("maker").isNotNull()).select("product_id", "maker"), "product_id")
    return found.join(own, ["q", "maker"], "left_anti").select("q", "product_id", "maker")


def drug_report(needles: DataFrame, products: DataFrame, ingredients: DataFrame, stopped: DataFrame, members: DataFrame, limit: int) -> DataFrame:
    """q, matched, alternative_products, alternative_makers, in_shortage, in_recall, equivalents of each needle; zeros where nothing is found."""
    matched = matching(products, ingredients, needles, limit)
    others = other_makers(matched, products, ingredients).join(stopped, "product_id", "left")
    flag = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    counts = others.groupBy("q").agg(F.count(F.lit(1)).alias("alternative_products"), F.countDistinct("maker").alias("alternative_makers"), flag("in_shortage").alias("in_shortage"), flag("in_recall").alias("in_recall"))
    groups = matched.join(members, "product_id").select("q", "group_id").distinct()
    same = groups.join(members, "group_id").select("q", "product_id").distinct().join(matched, ["q", "product_id"], "left_anti").groupBy("q").agg(F.count(F.lit(1)).alias("equivalents"))
    out = needles.join(matched.groupBy("q").agg(F.count(F.lit(1)).alias("matched")), "q", "left").join(counts, "q", "left").join(same, "q", "left")
    return out.select("q", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("matched", "alternative_products", "alternative_makers", "in_shortage", "in_recall", "equivalents")])


def drug_alternatives(needles: DataFrame, products: DataFrame, ingredients: DataFrame, stopped: DataFrame, limit: int) -> DataFrame:
    """q, place, product_id, maker: of each other maker its one product most in trouble; the first ``limit`` of a needle."""
    others = other_makers(matching(products, ingredients, needles, limit), products, ingredients).join(stopped, "product_id", "left")
    trouble = F.struct((~F.coalesce("in_recall", F.lit(False))).alias("r"), (~F.coalesce("in_shortage", F.lit(False))).alias("s"), F.col("product_id").alias("p"))
    one = others.groupBy("q", "maker").agg(F.min(trouble).alias("t"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("t"))).where(F.col("place") <= limit).select("q", "place", F.col("t.p").alias("product_id"), "maker")
