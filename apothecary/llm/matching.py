"""Match free descriptions to products of a directory that share no key with them.

Descriptions and products are brought to the same attributes: ingredient names (brand
names standing for ingredients), each with its strength in milligrams where the text tells
which is whose, salts, dosage form, labeler. Equal attribute sets are matched once. Names
and labelers are noisy: their character bigrams are encoded as 256-bit vectors, and all
pairs within ``RADIUS`` differing bits are found exactly by multi-index hashing (vectors
that close agree on one of ``RADIUS + 1`` parts). Strengths and form must agree outright,
so names meet only within their strengths and form, and labelers only within a name,
strengths and form besides: no index is searched across the whole directory. Pairs get a
field-weighted Dice score; scores become confidences by the share of right pairs per score
band among records that do carry a usable code.

Defined cases: records without key, records with a code of a directory product, and
products without ingredients or strengths are left out; a description without strength,
form, name or labeler matches nothing; where a text has as many strengths as names they
belong together in order, else only their totals are compared; equal products all match;
empty tables give no rows; repeated rows count once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apothecary.functions.text import normalize_ndc, record_key
from apothecary.operators.components import HOT_KEYS, lookup
from apothecary.session import materialise

BITS, RADIUS = 256, 6
#: Least Dice of a single name and of a labeler.
LEAST_DICE = 0.5
#: Weights of the fields in a pair's score; strengths and form must agree outright.
WEIGHTS = {"name": 0.5, "labeler": 0.35, "salt": 0.1, "kind": 0.05}
ACCEPT = 0.5
#: An attribute set that this many records share, or a thousandth of all, is cut into parts.
HOT_ROWS = 50_000

# Ways to write salts, dosage forms, firm kinds and legal forms.
SALT_WORDS = {
    "sodium": "sodium", "na": "sodium", "potassium": "potassium", "k": "potassium", "hydrochloride": "hydrochloride", "hcl": "hydrochloride",
    "maleate": "maleate", "mal": "maleate", "sulfate": "sulfate", "sulf": "sulfate", "sulphate": "sulfate", "acetate": "acetate", "acet": "acetate", "ac": "acetate",
}
FORMS = (
    ("injection", r"\binj(?:ection|ectable)?\b"),
    ("drops", r"\b(?:ophth(?:almic)?|eye|drops)\b"),
    ("patch", r"\b(?:patch(?:es)?|transdermal)\b"),
    ("cream", r"\b(?:cream|crm)\b"),
    ("capsule", r"\bcap(?:s|sules?)?\b"),
    ("tablet", r"\btab(?:s|lets?)?\b"),
    ("solution", r"\b(?:solution|soln|oral)\b"),
)
KINDS = {
    "laboratories": "laboratories", "labs": "laboratories", "lab": "laboratories", "laboratory": "laboratories", "therapeutics": "therapeutics", "therap": "therapeutics",
    "pharma": "pharma", "pharmaceuticals": "pharma", "pharmaceutical": "pharma", "biologics": "biologics", "biol": "biologics", "medicines": "medicines", "med": "medicines",
    "lifecare": "lifecare", "health": "health", "sciences": "health", "sci": "health", "drug": "drug", "works": "drug",
}
LEGAL = frozenset("the inc llc l c s a ltd co corp corporation company limited gmbh ag plc usa america intl international dist distributed by of and".split())
_NOISE = frozenset(
    "rx only film coated fc hard er extended release system topical per hour hr h ml g gram grams gm mg mcg ug l count ct x of and in with for made mfd mfg by manufactured distributed packaged dist "
    "bottle bottles vial vials tube tubes carton cartons dropper droppers box boxes pack packs blister ndc the a".split()
)
_FIRM = re.compile(r"\b(?:(?:manufactured|distributed|packaged|made|mfd|dist|pkgd|mfg|produced|marketed)\.?\s*(?:by|for)\b:?|mfg\.?:)\s*", re.I)
_STRENGTH = re.compile(r"(?<![\w/.,])(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?|\.\d+)\s*(mcg|µg|μg|ug|mg|grams?|gm|g)\b(?!\s*/\s*\d*\s*count)", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def milligrams(number: str, unit: str) -> str:
    """A strength in milligrams, written without trailing zeros."""
    scale = {"g": 1000, "m": 1, "u": Decimal("0.001")}
    u = unit.lower()
    factor = scale["u"] if u in ("mcg", "µg", "μg", "ug") else scale["g"] if u.startswith("g") else scale["m"]
    value = (Decimal(number.replace(",", "")) * factor).normalize()
    return f"{value:f}"


def strengths(text: str) -> list[str]:
    """All strengths of a text in milligrams, sorted."""
    return sorted(told_strengths(text))


def told_strengths(text: str) -> list[str]:
    """All strengths of a text in milligrams, in order; amounts after a slash or ``per`` are denominators."""
    out = []
    for m in _STRENGTH.finditer(text):
        if not re.search(r"(?:/|\bper)\s*$", text[: m.start()], re.I):
            out.append(milligrams(m[1], m[2]))
    return out


def form(text: str) -> str | None:
    low = text.lower()
    return next((name for name, pattern in FORMS if re.search(pattern, low)), None)


def firm(text: str | None) -> tuple[str | None, str | None]:
    """(all own words, kind) of a firm's name in any of its spellings."""
    ws = [w for w in _WORD.findall((text or "").lower()) if w not in LEGAL]
    own = [w for w in ws if w not in KINDS]
    kind = next((KINDS[w] for w in ws if w in KINDS), None)
    return (" ".join(own) or None), kind


_FORMED = re.compile("|".join(p for _, p in FORMS))


def own_words(text: str) -> list[str]:
    """Words that may be names, in order, each once."""
    ws = _WORD.findall(_STRENGTH.sub(" ", text).lower())
    return list(dict.fromkeys(w for w in ws if w not in SALT_WORDS and w not in _NOISE and len(w) > 1 and not _FORMED.fullmatch(w)))


def salts(text: str) -> list[str]:
    return sorted({SALT_WORDS[w] for w in _WORD.findall(_STRENGTH.sub(" ", text).lower()) if w in SALT_WORDS})


def is_long(word: str) -> bool:
    """Shorter words count as names only where the directory has them."""
    return len(word) > 3


def describe(product: str, generic: str | None, company: str | None) -> dict:
    """Attributes of a record: the firm comes from ``company`` or else from the text behind a word such as ``Mfd. by``.

    ``own`` holds the strength of each name, None where the text does not tell.
    """
    found = _FIRM.search(product)
    head = product[: found.start()] if found else product
    if company is None and found:
        tail = product[found.end() :]
        while again := _FIRM.match(tail):
            tail = tail[again.end() :]
        company = re.split(r"[,;(]|\s-\s|\.\s|$", tail, maxsplit=1)[0] or None
    head = re.sub(r"\(?\s*\bndc\b.*?(?:\)|$)", " ", head, flags=re.I)
    told, all_strengths = own_words(head), told_strengths(head)
    long = [w for w in told if is_long(w)]
    own = dict(zip(long, all_strengths)) if len(long) == len(all_strengths) > 1 else {}
    words = sorted({*told, *own_words(generic or "")})
    maker, kind = firm(company)
    return {"names": words, "own": [own.get(w) for w in words], "salts": salts(f"{head} {generic or ''}"), "strengths": sorted(all_strengths), "form": form(head), "maker": maker, "kind": kind}


def bigrams(word: str) -> set[str]:
    padded = f"^{word}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def vector(word: str) -> int:
    """The bigrams of a word as bits."""
    import xxhash

    return sum({1 << (xxhash.xxh3_64_intdigest(b) % BITS) for b in bigrams(word)})


def dice(a: str, b: str) -> float:
    x, y = bigrams(a), bigrams(b)
    return 2 * len(x & y) / (len(x) + len(y))


def _encoded(words: DataFrame) -> DataFrame:
    """Each word with its vector as parts (for the index) and whole (for the comparison)."""
    size = -(-BITS // (RADIUS + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[str, int] = {}
            rows = [known[w] if w in known else known.setdefault(w, vector(w)) for w in b.column(0).to_pylist()]
            parts = pa.array([[f"{i}:{(v >> (i * size)) & ((1 << size) - 1):x}" for i in range(RADIUS + 1)] for v in rows], pa.list_(pa.string()))
            whole = pa.array([[((v >> (64 * i)) & (2**64 - 1)) - (2**64 if (v >> (64 * i + 63)) & 1 else 0) for i in range(BITS // 64)] for v in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, parts, whole], ["word", "block", "parts", "bits"])

    return words.select("word", "block").mapInArrow(run, "word string, block string, parts array<string>, bits array<bigint>")


def meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that sorts both sides, whatever their estimated sizes.

    Estimates leave out how far lists unfold and files decompress: a side taken for 10 MB
    can be some hundred in memory, and a broadcast would hold it whole in the driver.
    """
    return left.join(right.hint("merge"), on, how)


def candidates(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of one block that agree on a part of their vectors: block, asked, a, known, k."""

    def index(words: DataFrame, name: str, bits: str) -> DataFrame:
        rows = _encoded(words).select(F.col("word").alias(name), "block", F.col("bits").alias(bits), F.explode("parts").alias("part"))
        return rows.select(name, "block", bits, F.xxhash64("block", "part").alias("key"))

    return meet(index(asked, "asked", "a"), index(known, "known", "k"), ["key", "block"]).drop("key")


def close_words(asked: DataFrame, known: DataFrame) -> DataFrame:
    """block, asked, known, dice: all pairs of one block within the radius, equal words with a Dice of 1.

    ``asked`` and ``known`` have distinct rows of ``word`` and ``block``.
    """
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.get("a", F.lit(i)).bitwiseXOR(F.get("k", F.lit(i)))) for i in range(BITS // 64)])
    ones = lambda c: reduce(lambda x, y: x + y, [F.bit_count(F.get(c, F.lit(i))) for i in range(BITS // 64)])
    near = candidates(asked, known).where((apart <= RADIUS) | (F.col("asked") == F.col("known")))
    score = F.when(F.col("asked") == F.col("known"), 1.0).otherwise(F.least(F.lit(0.99), (ones("a") + ones("k") - apart) / (ones("a") + ones("k"))))
    return near.select("block", "asked", "known", score.alias("dice")).where(F.col("dice") >= LEAST_DICE).distinct()


def _codes(feed: str) -> Column:
    """All codes a record carries, as written."""
    pattern = r"(?<![\w-])(\d{4,5}-\d{3,4}(?:-\d{1,2})?|\d{11})(?![\w-])"
    texts = ("product_description", "code_info", "more_code_info") if feed == "recalls" else ("presentation",)
    in_text = [F.coalesce(F.regexp_extract_all(F.col(c), F.lit(pattern), F.lit(1)), F.array().cast("array<string>")) for c in texts]
    listed = [F.coalesce(F.col(f"openfda.{c}"), F.array().cast("array<string>")) for c in ("package_ndc", "product_ndc")]
    own = [F.array(F.col("package_ndc"))] if feed == "shortages" else []
    return F.concat(*own, *listed, *in_text)


def coded(rows: DataFrame, ndc: DataFrame, feed: str) -> DataFrame:
    """record_key, product_ndc of records with a code that leads to a product: as its package or as its product code."""
    product = normalize_ndc(F.col("product_ndc"))
    of_product = ndc.select(F.substring(product, 1, 9).alias("code"), "product_ndc")
    of_package = ndc.select(F.explode("packaging").alias("p"), "product_ndc").select(normalize_ndc(F.col("p.package_ndc")).alias("code"), "product_ndc")
    index = of_product.unionByName(of_package).where(F.col("code").isNotNull()).distinct()
    carried = rows.select(record_key(feed).alias("record_key"), F.explode(_codes(feed)).alias("c")).select("record_key", normalize_ndc(F.col("c")).alias("full"))
    carried = carried.where(F.col("record_key").isNotNull() & F.col("full").isNotNull()).distinct()
    carried = carried.select("record_key", F.explode(F.array_distinct(F.array("full", F.substring("full", 1, 9)))).alias("code"))
    return meet(carried, index, ["code"]).select("record_key", "product_ndc").distinct()


_ATTRIBUTES = "names array<string>, own array<string>, salts array<string>, strengths string, form string, maker string, kind string"


def _described(rows: DataFrame) -> DataFrame:
    """feed, record_key and attributes of feed, record_key, product, generic, company."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("feed", pa.string()), ("record_key", pa.string()), ("names", pa.list_(pa.string())), ("own", pa.list_(pa.string())), ("salts", pa.list_(pa.string())), ("strengths", pa.string()), ("form", pa.string()), ("maker", pa.string()), ("kind", pa.string())])
        for b in batches:
            out = []
            for feed, key, product, generic, company in zip(*(b.column(k).to_pylist() for k in range(5))):
                d = describe(product or "", generic, company)
                if any(map(is_long, d["names"])) and d["strengths"] and d["form"] and d["maker"]:
                    out.append({"feed": feed, "record_key": key, **d, "strengths": "|".join(d["strengths"])})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, f"feed string, record_key string, {_ATTRIBUTES}")


def _products(ndc: DataFrame) -> DataFrame:
    """product_ndc and attributes of the products whose ingredients and strengths are known; ``brand`` beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("product_ndc", pa.string()), ("names", pa.list_(pa.string())), ("own", pa.list_(pa.string())), ("salts", pa.list_(pa.string())), ("strengths", pa.string()), ("form", pa.string()), ("maker", pa.string()), ("kind", pa.string()), ("brand", pa.list_(pa.string()))])
        for b in batches:
            out = []
            for code, brand, labeler, dosage, parts in zip(*(b.column(k).to_pylist() for k in range(5))):
                parts = [p for p in parts or [] if p and (p["name"] is not None or p["strength"] is not None)]
                if not parts or any(not (p["name"] or "").strip() or not strengths(p["strength"] or "") for p in parts):
                    continue
                maker, kind = firm(labeler)
                shape = form((dosage or "").replace("/", " "))
                # A name that several ingredients share has no strength of its own.
                each = [(w, "|".join(strengths(p["strength"]))) for p in parts for w in own_words(p["name"])]
                of = {w: {s for x, s in each if x == w} for w, _ in each}
                if of and shape and maker:
                    own = sorted(of)
                    mg = sorted(s for p in parts for s in strengths(p["strength"]))
                    out.append({"product_ndc": code, "names": own, "own": [min(of[w]) if len(of[w]) == 1 else None for w in own], "salts": sorted({s for p in parts for s in salts(p["name"])}), "strengths": "|".join(mg), "form": shape, "maker": maker, "kind": kind, "brand": own_words(brand or "")})
            yield pa.RecordBatch.from_pylist(out, schema)

    rows = ndc.where(F.col("product_ndc").isNotNull()).select("product_ndc", "brand_name", "labeler_name", "dosage_form", "active_ingredients")
    return rows.mapInArrow(run, f"product_ndc string, {_ATTRIBUTES}, brand array<string>")


def _score() -> Column:
    salt = F.when(F.col("salts") == F.col("p_salts"), 1.0).when((F.size("salts") == 0) | (F.size("p_salts") == 0), 0.6).otherwise(0.0)
    kind = F.when(F.col("kind") == F.col("p_kind"), 1.0).when(F.col("kind").isNull() | F.col("p_kind").isNull(), 0.6).otherwise(0.0)
    return F.lit(WEIGHTS["name"]) * F.col("name_dice") + F.lit(WEIGHTS["labeler"]) * F.col("maker_dice") + F.lit(WEIGHTS["salt"]) * salt + F.lit(WEIGHTS["kind"]) * kind


def score_pairs(sets: DataFrame, products: DataFrame) -> DataFrame:
    """sid, product_ndc, score of attribute sets (sid and attributes) that may be a product's.

    All ingredients of the product must be named, or its brand; strengths and form
    must be equal; names and labeler close. Of the pairs of a set the best are kept.
    """
    long_names = F.filter("names", lambda w: F.length(w) > 3)
    block = F.concat_ws("#", "strengths", "form").alias("block")
    each = sets.select("sid", block, "maker", "kind", "salts", F.size(long_names).alias("n_names"), F.explode(F.arrays_zip("names", "own")).alias("n"))
    each = each.select("sid", "block", "maker", "kind", "salts", "n_names", F.col("n.names").alias("asked"), F.col("n.own").alias("own"))
    told = products.select("product_ndc", block, F.col("maker").alias("p_maker"), F.col("kind").alias("p_kind"), F.col("salts").alias("p_salts"), "names", "own", "brand")
    entries = told.select("*", F.explode(F.arrays_zip("names", "own")).alias("n"), F.lit("ingredient").alias("role"), F.size("names").alias("need")).withColumns({"known": F.col("n.names"), "p_own": F.col("n.own")})
    brands = told.select("*", F.explode("brand").alias("known"), F.lit("brand").alias("role"), F.size("brand").alias("need")).withColumn("p_own", F.lit(None).cast("string"))
    columns = ["product_ndc", "p_maker", "p_kind", "p_salts", "p_own", "role", "need", "block", "known"]
    entry = entries.select(*columns).unionByName(brands.select(*columns))

    words = lambda df, c, within: df.select(F.col(c).alias("word"), F.col(within).alias("block")).distinct()
    lexicon = close_words(words(each, "asked", "block"), words(entry, "known", "block"))
    named = F.concat_ws("#", "known", "block").alias("name")
    rows = meet(each, lexicon, ["asked", "block"]).select("sid", "maker", "kind", "salts", "n_names", "own", "dice", "known", named)
    rows = materialise(rows, "match-names")
    entry = entry.select("product_ndc", "p_maker", "p_kind", "p_salts", "p_own", "role", "need", named)
    # Only names that some record has need their labelers searched.
    entry = materialise(meet(entry, rows.select("name").distinct(), ["name"], "left_semi"), "match-entries")
    makers = close_words(words(rows, "maker", "name"), words(entry, "p_maker", "name"))
    makers = makers.select(F.col("block").alias("name"), F.col("asked").alias("maker"), F.col("known").alias("p_maker"), F.col("dice").alias("maker_dice"))
    hits = meet(meet(rows, makers, ["name", "maker"]), entry, ["name", "p_maker"])
    hits = hits.where(F.col("own").isNull() | F.col("p_own").isNull() | (F.col("own") == F.col("p_own")))
    one = hits.groupBy("sid", "product_ndc", "role", "known").agg(
        F.max("dice").alias("dice"), F.first("need").alias("need"), F.max("maker_dice").alias("maker_dice"), F.first("kind").alias("kind"), F.first("p_kind").alias("p_kind"), F.first("salts").alias("salts"), F.first("p_salts").alias("p_salts"), F.first("n_names").alias("n_names")
    )
    per = one.groupBy("sid", "product_ndc", "role").agg(
        F.count(F.lit(1)).alias("met"), F.avg("dice").alias("name_dice"), F.first("need").alias("need"), F.max("maker_dice").alias("maker_dice"), F.first("kind").alias("kind"), F.first("p_kind").alias("p_kind"), F.first("salts").alias("salts"), F.first("p_salts").alias("p_salts"), F.first("n_names").alias("n_names")
    )
    full = per.where(F.col("met") == F.col("need")).withColumn("score", _score())
    both = full.groupBy("sid", "product_ndc").agg(F.max("score").alias("score"), F.sum("met").alias("met"), F.max("n_names").alias("n_names"))
    # A name that is no part of the product speaks against it.
    both = both.withColumn("score", F.col("score") - 0.15 * F.greatest(F.lit(0), F.col("n_names") - F.col("met")))
    best = Window.partitionBy("sid")
    return both.withColumn("top", F.max("score").over(best)).where(F.col("score") >= F.col("top") - 1e-9).select("sid", "product_ndc", "score")


def _bands(scored: DataFrame) -> DataFrame:
    return scored.withColumn("band", F.least(F.lit(19), F.floor(F.col("score") * 20)).cast("int"))


def match(recalls: DataFrame, shortages: DataFrame, ndc: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """feed, record_key, product_ndc, score, confidence of records without a usable code."""
    source = {
        "recalls": recalls.select("*", F.col("product_description").alias("_product"), F.lit(None).cast("string").alias("_generic"), F.lit(None).cast("string").alias("_company")),
        "shortages": shortages.select("*", F.col("presentation").alias("_product"), F.col("generic_name").alias("_generic"), F.coalesce("company_name", F.lit("")).alias("_company")),
    }
    codes = [coded(df, ndc, feed).select(F.lit(feed).alias("feed"), "record_key", "product_ndc") for feed, df in source.items()]
    codes = materialise(codes[0].unionByName(codes[1]), "match-codes")
    rows = [df.select(F.lit(feed).alias("feed"), record_key(feed).alias("record_key"), "_product", "_generic", "_company").where(F.col("record_key").isNotNull()).distinct() for feed, df in source.items()]
    attributes = ["names", "own", "salts", "strengths", "form", "maker", "kind"]
    described = _described(rows[0].unionByName(rows[1])).withColumn("sid", F.sha2(F.to_json(F.struct(*attributes)), 256))
    described = materialise(described, "match-records")
    products = materialise(_products(ndc).distinct(), "match-products")
    sets = described.groupBy("sid").agg(*[F.first(c).alias(c) for c in attributes])
    scored = materialise(_bands(score_pairs(sets, products)), "match-scores")
    # A set that very many records share is cut into parts by record; such sets are few.
    limit = max(hot_rows, described.count() // HOT_KEYS)
    many = {r["sid"]: 1 + r["n"] // max(1, limit // 2) for r in described.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).collect()}
    parts = lookup(many, F.col("sid"), F.lit(1).cast("bigint"))
    cut = scored.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    found = meet(described.select("feed", "record_key", "sid", F.pmod(F.xxhash64("record_key"), parts).alias("part")).distinct(), cut, ["sid", "part"])
    found = materialise(found.groupBy("feed", "record_key", "product_ndc").agg(F.max("score").alias("score"), F.max("band").alias("band")), "match-found")

    has_code = codes.select("feed", "record_key").distinct()
    known = meet(meet(found, has_code, ["feed", "record_key"], "left_semi"), codes.withColumn("right", F.lit(1)), ["feed", "record_key", "product_ndc"], "left")
    seen = {r["band"]: (r["right"] or 0, r["n"]) for r in known.groupBy("band").agg(F.sum("right").alias("right"), F.count(F.lit(1)).alias("n")).collect()}
    table = calibrate(seen)
    sure = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("band"))
    return meet(found, has_code, ["feed", "record_key"], "left_anti").select("feed", "record_key", "product_ndc", F.round("score", 4).alias("score"), sure.alias("confidence"))


def calibrate(seen: dict[int, tuple[int, int]], bands: int = 20) -> dict[int, float]:
    """Confidence of each score band from (right, all) counts: rising with the score, smoothed towards the score itself."""
    raw = []
    for b in range(bands):
        right, n = seen.get(b, (0, 0))
        raw.append([(right + 4 * (b + 0.5) / bands) / (n + 4), n + 4, 1])
    merged: list[list[float]] = []
    for value, weight, count in raw:
        merged.append([value, weight, count])
        while len(merged) > 1 and merged[-2][0] > merged[-1][0]:
            v, w, c = merged.pop()
            merged[-1] = [(merged[-1][0] * merged[-1][1] + v * w) / (merged[-1][1] + w), merged[-1][1] + w, merged[-1][2] + c]
    flat = [round(v, 4) for v, _, c in merged for _ in range(int(c))]
    return dict(enumerate(flat))
