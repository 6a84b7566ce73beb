"""Texts of evaluation records that stand, exactly or almost, in training records.

Equal word sequences become one class first. Two texts with three quarters of their
words in common must share one of the first ``n - ceil(0.75 n) + 1`` words in a fixed
order, rare ones first, whatever else differs: each class meets the others by these words
alone. What a shared word still allows decides next: its places in both orders bound the
words that can be shared, and so do the differing bits of two 128-bit word sums. A word
that too many pairs share is keyed by the sizes its place allows as well. None of this
loses a pair. For each candidate pair the shared words are counted exactly. Where coverage
is asked for, five-word seeds that stand once in each text are chained collinearly and the
gaps between them aligned word by word.

Defined cases: NULL, blank and placeholder texts and ``excluded`` records never count;
a text without words never counts; repeated rows are one record; a NULL id is left out.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.functions.text import is_blank, strip
from apothecary.operators.components import HOT_KEYS, lookup
from apothecary.session import materialise

#: Words in a row that seed an alignment.
SHINGLE = 5
#: Shared distinct words over all distinct words, in hundredths.
SIMILARITY = 75
#: A word with more train-evaluation pairs of classes than this is keyed by sizes as well.
HOT_PAIRS = 256
#: A class with this many records, or a thousandth of all, is cut into parts before its records meet.
HOT_ROWS = 50_000
#: Bands of text sizes to a factor of e.
BANDS = 8
#: Words in at least this part of all records count as frequent; no more than ``100 * words a record`` can be.
FREQUENT = 100
EVALUATION = ("validation", "test", "gold_evaluation")
PLACEHOLDER = "[fda reason missing]"
_WORD = re.compile(r"[a-z0-9]+")


def words(text: str) -> list[str]:
    """Runs of a-z and 0-9 without regard to case and accents."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.lower())


def records(df: DataFrame) -> DataFrame:
    """candidate_id, split, source, words (joined by blanks), class of the records that count."""
    side = F.col("split").isin("train", *EVALUATION)
    real = ~is_blank(F.col("raw_text")) & (F.lower(strip(F.col("raw_text"))) != PLACEHOLDER)
    rows = df.where(side & real & F.col("candidate_id").isNotNull()).select("candidate_id", "split", "source", "raw_text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([" ".join(words(t)) for t in b.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], texts], ["candidate_id", "split", "source", "words"])

    out = rows.mapInArrow(run, "candidate_id string, split string, source string, words string").where(F.col("words") != "")
    return out.withColumn("class", F.md5("words"))


def _hash(ws: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), np.uint64, len(ws))


def prefix(distinct: list[str], frequent: dict[str, int]) -> list[str]:
    """The words of which any text similar enough must share one: the rarest in a fixed order."""
    n = len(distinct)
    keep = n - -(-SIMILARITY * n // 100) + 1
    return sorted(distinct, key=lambda w: (frequent.get(w, 0), w))[:keep]


def band(size: int) -> int:
    return int(math.log(size) * BANDS)


def keys(n: int, first: list[int]) -> list[dict]:
    """Each word of the prefix with its place from 1 and the bands of the sizes that a similar text may then have."""
    out = []
    for at, w in enumerate(first, 1):
        low, high = -(-SIMILARITY * n // 100), min(100 * n // SIMILARITY, (100 + SIMILARITY) * (n - at + 1) // SIMILARITY - n)
        if low <= high:
            out.append({"w": w, "at": at, "low": band(low), "high": band(high)})
    return out


def word_sum(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits, each the parity of the words that fall on it: as many differ at most as words do."""
    bits = np.bincount((hashes & np.uint64(127)).astype(np.int64), minlength=128) & 1
    low, high = np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()
    return low, high


def align(a: list[str], b: list[str]) -> int:
    """Words of ``b`` that stand in ``a`` along one collinear chain of seeds, gaps aligned word by word."""
    of_a = _places(a)
    # At most one seed a place, so repeated passages cost no more than others; the gaps still find them.
    seeds = sorted((j, of_a[k]) for k, j in _places(b).items() if j >= 0 and of_a.get(k, -1) >= 0)
    tails: list[int] = []
    last: list[int] = []
    back: list[int] = []
    for s, (_, i) in enumerate(seeds):
        k = bisect.bisect_left(tails, i)
        back.append(last[k - 1] if k else -1)
        if k == len(tails):
            tails.append(i)
            last.append(s)
        else:
            tails[k], last[k] = i, s
    chain, s = [], last[-1] if last else -1
    while s >= 0:
        chain.append(seeds[s])
        s = back[s]
    covered, pa_, pb = 0, 0, 0
    for j, i in [*reversed(chain), (len(b), len(a))]:
        covered += _common(a[pa_:i], b[pb:j])
        end = min(SHINGLE, len(b) - j)
        fresh = max(0, j + end - max(j, pb))
        covered += fresh
        pa_, pb = max(pa_, i + end), max(pb, j + end)
    return covered


def _places(words_: list[str]) -> dict[tuple, int]:
    """The place of each shingle, -1 if it has several."""
    out: dict[tuple, int] = {}
    for i in range(len(words_) - SHINGLE + 1):
        k = tuple(words_[i : i + SHINGLE])
        out[k] = -1 if k in out else i
    return out


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of a gap, by bits of one long number a row."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for y in b:
        if y in masks:
            hit = row & masks[y]
            row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def frequent_words(recs: DataFrame, total: int) -> dict[str, int]:
    """Words in at least a hundredth of all records, with their counts: a bounded list."""
    each = recs.select(F.explode(F.array_distinct(F.split("words", " "))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {r["w"]: r["n"] for r in each.where(F.col("n") >= max(2, total // FREQUENT)).collect()}


def class_pairs(recs: DataFrame, hot_pairs: int = HOT_PAIRS, aligned: bool = True) -> DataFrame:
    """train, eval (class ids), shared, either (distinct word counts), covered (0 unless ``aligned``), eval_words of similar, different classes."""
    spark = recs.sparkSession
    classes = recs.groupBy("class").agg(F.min("words").alias("words"), F.max(F.col("split") == "train").alias("t"), F.max(F.col("split") != "train").alias("e"))
    classes = materialise(classes, "overlap-classes")
    frequent = spark.sparkContext.broadcast(frequent_words(classes, classes.count()))

    kind = pa.list_(pa.struct([("w", pa.int64()), ("at", pa.int32()), ("low", pa.int32()), ("high", pa.int32())]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequent.value
        for b in batches:
            sizes, bands, sums, found = [], [], [], []
            for text in b.column(1).to_pylist():
                distinct = list(dict.fromkeys(text.split(" ")))
                sizes.append(len(distinct))
                bands.append(band(len(distinct)))
                sums.append(word_sum(_hash(distinct)))
                found.append(keys(len(distinct), _hash(prefix(distinct, often)).view(np.int64).tolist()))
            halves = [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)]
            cols = [b.column(0), pa.array(sizes, pa.int32()), pa.array(bands, pa.int32()), b.column(2), b.column(3), *halves, pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "size", "band", "t", "e", "s0", "s1", "keys"])

    shape = "id binary, size int, band int, t boolean, e boolean, s0 bigint, s1 bigint, keys array<struct<w: bigint, at: int, low: int, high: int>>"
    rows = classes.select(F.unhex("class").alias("id"), "words", "t", "e").mapInArrow(prefixes, shape)
    rows = materialise(rows, "overlap-prefixes")
    each = rows.select("id", "size", "band", "t", "e", "s0", "s1", F.inline("keys"))
    counts = each.groupBy("w").agg(F.count_if("t").alias("nt"), F.count_if("e").alias("ne"), F.count(F.lit(1)).alias("n"))
    counts = counts.where((F.col("nt") > 0) & (F.col("ne") > 0) & (F.col("n") > 1)).select("w", (F.col("nt") * F.col("ne") > hot_pairs).alias("hot"))
    both = each.join(counts, "w")
    # Cold words meet whatever the sizes; hot ones only in the bands of both sizes.
    to = F.explode(F.when(F.col("hot"), F.sequence("low", "high")).otherwise(F.array(F.lit(-1)))).alias("to")
    keyed = both.select("w", "id", "size", "at", "s0", "s1", "t", "e", F.when(F.col("hot"), F.col("band")).otherwise(-1).alias("own"), to)
    keyed = materialise(keyed, "overlap-keys")
    side = lambda name, own, to: [F.col(own).alias("train_band"), F.col(to).alias("eval_band"), F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("size", "at", "s0", "s1")]]
    train = keyed.where("t").select("w", *side("train", "own", "to"))
    held = keyed.where("e").select("w", *side("eval", "to", "own"))
    n, m = F.col("train_size"), F.col("eval_size")
    near = (n * 100 >= m * SIMILARITY) & (m * 100 >= n * SIMILARITY)
    reach = (1 + F.least(n - F.col("train_at"), m - F.col("eval_at"))) * (100 + SIMILARITY) >= (n + m) * SIMILARITY
    apart = F.bit_count(F.col("train_s0").bitwiseXOR(F.col("eval_s0"))) + F.bit_count(F.col("train_s1").bitwiseXOR(F.col("eval_s1")))
    close = apart * (100 + SIMILARITY) <= (n + m) * (100 - SIMILARITY)
    pairs = train.join(held, ["w", "train_band", "eval_band"]).where(near & reach & close & (F.col("train") != F.col("eval"))).select("train", "eval").distinct()
    text = lambda side: classes.select(F.unhex("class").alias(side), F.col("words").alias(f"{side}_text"))
    pairs = pairs.join(text("train"), "train").join(text("eval"), "eval")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, e, tw, ew in zip(*(b.column(k).to_pylist() for k in range(4))):
                a, c = tw.split(" "), ew.split(" ")
                x, y = set(a), set(c)
                shared = len(x & y)
                either = len(x) + len(y) - shared
                if shared * 100 >= SIMILARITY * either:
                    out.append((t.hex(), e.hex(), shared, either, align(a, c) if aligned else 0, len(c)))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["train", "eval", "shared", "either", "covered", "eval_words"])

    return pairs.select("train", "eval", "train_text", "eval_text").mapInArrow(verify, "train string, eval string, shared int, either int, covered int, eval_words int")


def _links(recs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similar pairs of classes together with each class that stands on both sides."""
    same = recs.groupBy("class").agg(F.max(F.col("split") == "train").alias("t"), F.max(F.col("split") != "train").alias("e"), F.min("words").alias("words")).where("t and e")
    n, d = F.size(F.split("words", " ")), F.size(F.array_distinct(F.split("words", " ")))
    same = same.select(F.col("class").alias("train"), F.col("class").alias("eval"), d.alias("shared"), d.alias("either"), n.alias("covered"), n.alias("eval_words"))
    return pairs.unionByName(same)


def prepare(df: DataFrame, aligned: bool = True) -> tuple[DataFrame, DataFrame]:
    """The records that count, and the links between their classes."""
    recs = materialise(records(df), "overlap-records")
    return recs, _links(recs, class_pairs(recs, aligned=aligned))


def record_pairs(df: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """id_a, id_b of every similar train and evaluation record, the smaller id first.

    A class with very many records is cut into parts by record id on either side, and each
    part of one side meets each part of the other in a task of its own.
    """
    recs, links = prepare(df, aligned=False)
    limit = max(hot_rows, recs.count() // HOT_KEYS)
    sizes = recs.groupBy("class").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit)
    parts = {r["class"]: 1 + r["n"] // max(1, limit // 2) for r in sizes.collect()}
    many = lambda c: lookup(parts, F.col(c), F.lit(1).cast("bigint"))

    def side(name: str, which) -> DataFrame:
        own = recs.where(which).select(F.col("class").alias(name), F.col("candidate_id").alias(f"{name}_id")).distinct()
        return own.withColumn(f"{name}_part", F.pmod(F.xxhash64(f"{name}_id"), many(name)))

    for name in ("train", "eval"):
        links = links.withColumn(f"{name}_part", F.explode(F.sequence(F.lit(0).cast("bigint"), many(name) - 1)))
    pairs = links.select("train", "eval", "train_part", "eval_part").join(side("train", F.col("split") == "train"), ["train", "train_part"]).join(side("eval", F.col("split") != "train"), ["eval", "eval_part"])
    pairs = pairs.where(F.col("train_id") != F.col("eval_id"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def overlaps(df: DataFrame) -> DataFrame:
    """One row per overlapping evaluation record: class, classes it meets in train and the greatest similarity, without alignment."""
    recs, links = prepare(df, aligned=False)
    best = links.groupBy(F.col("eval").alias("class")).agg(F.count(F.lit(1)).alias("train_classes"), F.max(F.round(F.col("shared") / F.col("either"), 4)).alias("similarity"))
    held = recs.where(F.col("split") != "train").select("candidate_id", "split", "source", "class").distinct()
    return held.join(best, "class").select("candidate_id", "split", "source", "class", "train_classes", "similarity")


def coverage(df: DataFrame) -> DataFrame:
    """One row per overlapping evaluation record: class, classes it meets in train, greatest coverage and similarity."""
    recs, links = prepare(df)
    best = links.groupBy(F.col("eval").alias("class")).agg(
        F.count(F.lit(1)).alias("train_classes"), F.max(F.round(F.col("covered") / F.col("eval_words"), 4)).alias("coverage"), F.max(F.round(F.col("shared") / F.col("either"), 4)).alias("similarity")
    )
    held = recs.where(F.col("split") != "train").select("candidate_id", "split", "source", "class").distinct()
    return held.join(best, "class").select("candidate_id", "split", "source", "class", "train_classes", "coverage", "similarity")


def report(df: DataFrame) -> DataFrame:
    """split, source, overlapping records and mean coverage."""
    return coverage(df).groupBy("split", "source").agg(F.countDistinct("candidate_id").alias("records"), F.round(F.avg("coverage"), 4).alias("coverage"))
