"""Rule-based cause of a reason text, as one set of column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apothecary.functions.text import strip

# Category, rule, weight and pattern of each rule.
RULES = (
    ("inactive_ingredient_shortage", "inactive_ingredient_shortage", 1.0, r"shortage of (?:an )?inactive ingredient(?: component)?|inactive ingredient shortage|excipient shortage"),
    ("active_ingredient_shortage", "active_ingredient_shortage", 1.0, r"shortage of (?:an )?active (?:pharmaceutical )?ingredient|active (?:pharmaceutical )?ingredient shortage|\bapi shortage\b"),
    ("manufacturing_quality_problem", "sterility", 1.0, r"steril(?:ity|e|ization)|aseptic"),
    ("manufacturing_quality_problem", "contamination", 1.0, r"contaminat|cross[- ]contamin|microbial|bacteri|fungal|mold|endotoxin"),
    ("manufacturing_quality_problem", "gmp_deviation", 1.0, r"\b(?:c?gmp|good manufacturing practice)s?\b|manufacturing quality problem"),
    ("manufacturing_quality_problem", "failed_quality_specification", 1.0, r"(?:fail(?:ed|ure)?|out[- ]of[- ]specification|\boos\b).{0,45}(?:specification|assay|dissolution|potency|stability)|(?:specification|assay|dissolution|potency|stability).{0,45}(?:fail(?:ed|ure)?|out[- ]of[- ]specification|\boos\b)"),
    ("manufacturing_quality_problem", "out_of_specification_or_potency", 1.0, r"out[- ]of[- ]specification|\boos\b|\b(?:subpoten|superpoten)"),
    ("manufacturing_quality_problem", "unsupported_stability_or_expiry", 1.0, r"stability data (?:does|do|did) not support|(?:lack|insufficient|absence) of stability data|expir(?:y|ation).{0,35}not supported"),
    ("manufacturing_quality_problem", "product_quality_attribute", 1.0, r"impurit|degrad|particul|foreign (?:matter|material|substance|tablet|capsule)|discolor|crystalli|precipitat"),
    ("manufacturing_quality_problem", "process_or_container_control", 1.0, r"processing controls?|quality controls?|container closure|defective container|fill volume|leak(?:ing|age)?"),
    ("manufacturing_quality_problem", "quality_language", 0.55, r"\b(?:potency|dissolution|stability|specification)s?\b"),
    ("manufacturing_capacity", "manufacturing_delay", 1.0, r"manufacturing delays?|production delays?|delay in (?:manufacturing|production)"),
    ("manufacturing_capacity", "capacity_constraint", 1.0, r"manufacturing capacity|production capacity|capacity constraint|unable to meet (?:production|supply)|supply interruption"),
    ("manufacturing_capacity", "equipment_or_facility_shutdown", 1.0, r"equipment (?:failure|breakdown)|(?:plant|facility|production line) (?:shutdown|closure)"),
    ("regulatory_delay", "regulatory_delay", 1.0, r"regulatory delay|approval delay|awaiting (?:fda|regulatory) approval|pending regulatory (?:review|approval)"),
    ("shipping_delay", "shipping_or_transit_delay", 1.0, r"delay(?:ed)? (?:in )?shipping|shipping delay|distribution delay|transportation delay|transit delay|freight delay|logistics delay"),
    ("demand_increase", "demand_increase", 1.0, r"demand increase|increase(?:d)? in demand|increased demand|demand (?:exceeds|exceeded)|unexpected demand|surge in demand"),
    ("product_discontinuation", "product_discontinuation", 1.0, r"discontinuation of (?:the )?manufacture|product discontinuation|product (?:is |was |has been )?discontinued|discontinued (?:the )?(?:drug|product|manufactur|production)|ceas(?:e|ed|ing) (?:manufactur|production)|no longer manufactur"),
    ("labeling_packaging_error", "labeling_error", 1.0, r"\blabeling\b|\blabel(?:ed|ing)? (?:error|mix[- ]?up|incorrect|missing|omits?|states?|lists?)|incorrect or missing (?:lot|exp(?:iration)?|package insert)"),
    ("labeling_packaging_error", "mispackaging_or_wrong_product", 1.0, r"mispack|\bmislabel(?:ed|ing)?\b|wrong product|incorrect product|unit dose mix[- ]?up|product mix[- ]?up"),
    ("regulatory_noncompliance", "unapproved_or_misbranded", 1.0, r"unapproved (?:new )?(?:drug|product)|misbrand|(?:marketed|marked) without (?:an? )?approved (?:nda|anda|nda/anda)|without (?:fda|regulatory) approval"),
    ("regulatory_noncompliance", "unregistered_manufacturer", 1.0, r"not registered with (?:the )?fda|unregistered (?:drug )?manufacturer"),
    ("adverse_event_signal", "adverse_event_or_reaction", 1.0, r"adverse (?:event|reaction|drug event|drug reaction)s?"),
)
# Which category wins among equal scores, first to last.
PRIORITY = (
    "inactive_ingredient_shortage", "active_ingredient_shortage", "regulatory_delay", "regulatory_noncompliance", "labeling_packaging_error", "shipping_delay",
    "demand_increase", "product_discontinuation", "manufacturing_capacity", "manufacturing_quality_problem", "adverse_event_signal",
)
# The stage of the supply chain that each category speaks of.
STAGES = {
    "active_ingredient_shortage": "raw_material_sourcing", "inactive_ingredient_shortage": "raw_material_sourcing", "manufacturing_quality_problem": "manufacturing",
    "manufacturing_capacity": "manufacturing", "regulatory_delay": "regulatory_review", "shipping_delay": "distribution", "demand_increase": "demand_planning",
    "product_discontinuation": "product_lifecycle", "labeling_packaging_error": "packaging_labeling", "regulatory_noncompliance": "regulatory_compliance",
    "adverse_event_signal": "post_market_surveillance", "recall": "post_market_action", "unknown": "unknown",
}
# The feed's own phrases and the category each stands for.
PHRASES = {
    "Shortage of an active ingredient": "active_ingredient_shortage", "Shortage of an inactive ingredient component": "inactive_ingredient_shortage",
    "Requirements related to complying with good manufacturing practices": "manufacturing_quality_problem", "Demand increase for the drug": "demand_increase",
    "Delay in shipping of the drug": "shipping_delay", "Regulatory delay": "regulatory_delay", "Discontinuation of the manufacture of the drug": "product_discontinuation", "Other": "unknown",
}
# Families of reasons that no category covers, and families at the edge of several.
GAP_FAMILIES = {"storage_temperature_excursion": r"temperature excursion|storage temperature|temperature abuse|improper storage", "counterfeit_or_tampering": r"counterfeit|tamper"}
EDGE_FAMILIES = {
    "temperature_abuse": r"temperature abuse|temperature excursion", "defective_delivery_system": r"defective delivery system", "subpotent_phrasing": r"\bsubpotent\b|\bsub-potent\b",
    "tablet_imprint": r"tablet imprint|incorrect imprint|missing imprint", "undeclared_excipients": r"undeclared excipient|incorrect excipient",
    "shipping_quality_collision": r"(?:shipping|transit) delay.*temperature|temperature.*(?:shipping|transit) delay", "dual_cause_and": r"\b(?:and|additionally|also)\b",
}
CAPACITY_CONTEXT = r"production|manufactur|facility|plant|equipment|supply"
CAPACITY_PRESSURE = r"capacity|unable|cannot|could not|delay|shortage|interruption|shutdown|closed|closure|out of business|production issue|equipment failure"
PILOT_EDGE = r"temperature|delivery system|subpotent|imprint|excipient|shipping|transit|mislab"


def in_family(text: Column, pattern: str) -> Column:
    """True where a pattern stands in the text, in any case; NULL text is in no family."""
    return F.coalesce(F.lower(F.replace(text, F.lit("\r"), F.lit(""))).rlike(pattern), F.lit(False))


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def severity(is_recall: Column, classification: Column, availability: Column, status: Column) -> Column:
    """high, medium or low: by class for recalls, by availability and then status for shortages; medium where nothing tells."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    recall = F.when(plain(classification) == "class i", "high").when(plain(classification) == "class iii", "low").otherwise("medium")
    short = F.when(plain(availability) == "unavailable", "high").when(plain(availability) == "limited availability", "medium").when(plain(status) == "resolved", "low").otherwise("medium")
    return F.when(is_recall, recall).otherwise(short)


def events(df: DataFrame) -> DataFrame:
    """``df`` (is_recall, text, classification, availability, status) with the whole event of each record:
    cause, confidence, stage, severity, secondary causes, evidence, fallback, collision."""
    out = classify(df, F.col("text"))
    stage = F.element_at(F.create_map(*[F.lit(x) for kv in STAGES.items() for x in kv]), F.col("cause"))
    others = F.transform(F.filter(F.split("matched", r"\|"), lambda m: (m != "") & (m != F.col("cause"))), lambda m: F.concat(F.lit("also_matched:"), m))
    secondary = F.when(F.col("is_recall") & (F.col("cause") != "recall"), F.concat(others, F.array(F.lit("recall_event")))).otherwise(others)
    field = F.when(F.col("is_recall"), "FDA reason_for_recall: ").otherwise("FDA shortage_reason: ")
    text = strip(F.coalesce("text", F.lit("")))
    told = [F.concat(field, F.when(text != "", text).otherwise("not supplied"))]
    told += [F.when(_filled(F.col(c)), F.concat(F.lit(f"FDA {c}: "), F.col(c))) for c in ("classification", "status", "availability")]
    evidence = F.filter(F.array(*told), lambda x: x.isNotNull())
    return out.withColumns(
        {
            "stage": stage, "secondary": secondary, "evidence": evidence, "fallback": F.col("matched") == "", "collision": F.size(F.split("matched", r"\|")) > 1,
            "severity": severity(F.col("is_recall"), F.col("classification"), F.col("availability"), F.col("status")),
        }
    )


def category_score(text: Column, category: str) -> Column:
    """Sum of the weights of a category's rules that match."""
    hits = [F.when(text.rlike(p), F.lit(w)).otherwise(F.lit(0.0)) for c, _, w, p in RULES if c == category]
    return F.round(reduce(lambda a, b: a + b, hits), 3)


def classify(df: DataFrame, text: Column) -> DataFrame:
    """Add cause, confidence_score, confidence, matched (categories in order of priority); NULL texts are unknown."""
    # In lower case no pattern needs to ignore case; one pass over all of them spares most texts the rest.
    plain = F.lower(F.coalesce(F.trim(F.replace(text, F.lit("\r"), F.lit(""))), F.lit("")))
    any_rule = "|".join(f"(?:{p})" for _, _, _, p in RULES)
    scores = F.filter(F.array(*[F.struct(category_score(plain, c).alias("score"), F.lit(-i).alias("rank"), F.lit(c).alias("category"), F.lit(max(w for d, _, w, _ in RULES if d == c)).alias("w")) for i, c in enumerate(PRIORITY)]), lambda s: s["score"] > 0)
    scores = F.when(plain.rlike(any_rule), scores).otherwise(F.array().cast("array<struct<score:double,rank:int,category:string,w:double>>"))
    out = df.select("*", F.explode(F.array(scores)).alias("_s"))
    top = F.array_max("_s")
    rest = F.array_max(F.transform(F.filter("_s", lambda s: s["category"] != top["category"]), lambda s: s["score"]))
    sure = F.round(F.least(F.lit(1.0), top["score"]) * top["score"] / (top["score"] + F.coalesce(rest, F.lit(0.0))), 3)
    strong = top["score"] >= 1.0
    level = F.when(F.size("_s") == 0, "low").when(~strong | (sure < 0.60), "low").when(F.size("_s") > 1, "medium").otherwise("high")
    return out.withColumns(
        {
            "cause": F.coalesce(top["category"], F.lit("unknown")),
            "confidence_score": F.coalesce(sure, F.lit(0.0)),
            "confidence": level,
            "matched": F.array_join(F.transform("_s", lambda s: s["category"]), "|"),
        }
    ).drop("_s")


def pairs_of(classified: DataFrame, *keep: str) -> DataFrame:
    """a, b and the kept columns, one row for each two categories that match a text; there are eleven categories at most."""
    each = classified.select(*keep, F.split("matched", r"\|").alias("m")).where(F.size("m") > 1)
    pairs = F.flatten(F.transform("m", lambda x, i: F.transform(F.slice("m", i + 2, F.size("m")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return each.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.a", "p.b")


def collision_pairs(classified: DataFrame) -> DataFrame:
    """a, b, n: how often two categories match one text."""
    return pairs_of(classified).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
