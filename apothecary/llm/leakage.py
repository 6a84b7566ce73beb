"""Evaluation passages inside a training corpus.

Windows of the held-out items meet equally long windows of every document. Each window,
a string of word hashes, takes a CGK random walk: step j emits the current word and moves
on by a random bit of (j, word), so a small edit distance between windows becomes a small
Hamming distance between walks. Bit sampling reads a few steps of each walk; windows whose
samples agree in any of several repetitions are candidates. Their words are then compared
exactly, so the result holds no false pair.

With no edits allowed, equal windows have equal walks and one repetition finds every pair.
With edits, the number of repetitions is measured on made-up windows with mixed edits, so
that a single pair of windows is found with the target recall.

Items whose words number at most ``BROADCAST_WORDS`` are sent to all tasks, where each
worker builds their index once. More items never pass through the driver: their signatures
are a table, and the documents' windows meet it in a join. A bitmap of fixed size, filled
from the item signatures, keeps nearly all document windows out of that join; hot
signatures are salted by document. Either way every document is read once.

Defined cases: NULL, empty and short texts have no windows; an item shorter than a window
leaks nowhere; repeated documents and items are all reported; empty tables give no rows.
"""

from __future__ import annotations

import random
import re
import sys
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apothecary.session import materialise

WINDOW = 14
#: Words of items that are sent to all tasks: 24 bytes a window and repetition, and the words.
BROADCAST_WORDS = 500_000
#: Bitmap of item signatures: so many parts of so many bits, 16 MB together.
PARTS, PART_BITS = 64, 21
#: Copies of each item signature, so that one which very many documents hold spreads over tasks.
SALTS = 8
#: Document words embedded at a time.
CHUNK = 200_000
#: Steps of a walk that one repetition reads: many without edits, fewer where edits must slip between.
SAMPLES, SAMPLES_NEAR = 12, 5
_JOIN = re.compile(r"(?<=[a-z0-9])[-\u2010\u00ad][ \t]*\r?\n[ \t]*(?=[a-z0-9])")
_WORD = re.compile(r"[a-z0-9]+")


def words(text: str | None) -> list[str]:
    """Runs of a-z and 0-9 in lower case, after joining words that a hyphen parts at a line end."""
    return _WORD.findall(_JOIN.sub("", (text or "").lower()))


class Hasher:
    """64-bit word hashes, remembered up to a bound."""

    def __init__(self, most: int = 200_000):
        import xxhash

        self.digest, self.known, self.most = xxhash.xxh3_64_intdigest, {}, most

    def __call__(self, ws: list[str]) -> np.ndarray:
        known, digest = self.known, self.digest
        if len(known) > self.most:
            known.clear()
        return np.fromiter((known.get(w) or known.setdefault(w, digest(w)) for w in ws), np.uint64, len(ws))


def edited(window: int, edits: int, pairs: int, seed: int = 11) -> list[tuple[list[int], list[int]]]:
    """Made-up pairs of windows at most ``edits`` apart: words replaced, put in and left out at random places."""
    rng = random.Random(seed)
    out = []
    while len(out) < pairs:
        a = [rng.getrandbits(64) for _ in range(window + edits)]
        b = list(a)
        for _ in range(edits):
            at = rng.randrange(window)
            b[at : at + rng.randrange(2)] = [] if rng.random() < 1 / 3 else [rng.getrandbits(64)]
        a, b = a[:window], b[:window]
        if len(b) == window and 0 < edit_distance(a, b, edits) <= edits:
            out.append((a, b))
    return out


@lru_cache
def repetitions(window: int, edits: int, recall: float, samples: int, pairs: int = 2_000, most: int = 96) -> int:
    """Repetitions of bit sampling that find ``recall`` of window pairs up to ``edits`` apart.

    Measured on made-up pairs, with two hundredths to spare; ``most`` where even those do not suffice.
    """
    if edits == 0:
        return 1
    made = edited(window, edits, pairs)
    sig = [signatures(np.array([w for p in made for w in p[side]], np.uint64), window, most, samples)[::window] for side in (0, 1)]
    share = np.logical_or.accumulate(sig[0] == sig[1], axis=1).mean(axis=0)
    enough = np.flatnonzero(share >= min(0.999, recall + 0.02))
    return int(enough[0]) + 1 if len(enough) else most


def signatures(h: np.ndarray, window: int, repeats: int, samples: int) -> np.ndarray:
    """(windows, repeats): a 64-bit signature of each window of the word hashes ``h`` in each repetition."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty((0, repeats), np.uint64)
    out = np.zeros((n, repeats), np.uint64)
    # Zeros behind the words, so that a walk past the end reads nothing; within the first
    # ``window`` steps no walk can have left its window.
    padded = np.concatenate([h, np.zeros(2 * window, np.uint64)])
    base = np.arange(n)
    for k in range(repeats):
        rng = np.random.default_rng(977 + k)
        turns = rng.integers(1, 2**63, 3 * window, dtype=np.uint64) | np.uint64(1)
        sampled = np.sort(rng.choice(2 * window, samples, replace=False))
        mixers = rng.integers(1, 2**63, 3 * window, dtype=np.uint64) | np.uint64(1)
        place = base.copy()
        for j in range(int(sampled[-1]) + 1):
            symbol = padded[place]
            if j >= window:
                symbol *= (place - base < window).astype(np.uint64)
            if j in sampled:
                mixed = (symbol ^ (symbol >> np.uint64(31))) * mixers[j]
                out[:, k] += mixed ^ (mixed >> np.uint64(29))
            symbol *= turns[j]
            symbol >>= np.uint64(63)
            place += symbol.view(np.int64)
    return out


def edit_distance(a: list, b: list, most: int) -> int:
    """Word edit distance, or ``most + 1`` where it is larger."""
    if a == b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _index(items: list[tuple], window: int, repeats: int, samples: int):
    """Sorted signatures of all item windows a repetition, with item and place of each."""
    hasher, sigs, owner, place = Hasher(), [], [], []
    split = [words(t) for _, t in items]
    for i, ws in enumerate(split):
        s = signatures(hasher(ws), window, repeats, samples)
        sigs.append(s)
        owner.append(np.full(len(s), i))
        place.append(np.arange(len(s)))
    if not sigs:
        return None
    s, o, p = np.concatenate(sigs), np.concatenate(owner), np.concatenate(place)
    order = [np.argsort(s[:, k], kind="stable") for k in range(repeats)]
    return [(s[r, k], o[r], p[r]) for k, r in enumerate(order)], split, [i for i, _ in items]


def _gathered(ids: list, texts, window: int) -> Iterator[tuple[list, list[str], np.ndarray]]:
    """(documents, their words in one list, where each document's words end) of about ``CHUNK`` words at a time."""
    docs, flat, ends = [], [], []
    for doc, text in zip(ids, texts):
        ws = words(text.as_py())
        if len(ws) >= window:
            docs.append(doc)
            flat += ws
            ends.append(len(flat))
        if len(flat) >= CHUNK:
            yield docs, flat, np.array(ends)
            docs, flat, ends = [], [], []
    if docs:
        yield docs, flat, np.array(ends)


def _kept_index(key: str, items: list[tuple], window: int, repeats: int, samples: int):
    """The index of the items, built once a worker process; only the last one is kept."""
    kept = sys.modules.setdefault("_apothecary_leakage", ModuleType("_apothecary_leakage")).__dict__
    if kept.get("key") != key:
        kept["index"], kept["key"] = _index(items, window, repeats, samples), key
    return kept["index"]


def _windows(batches: Iterator[pa.RecordBatch], window: int, repeats: int, samples: int, hits: Callable) -> Iterator[tuple[int, list[tuple]]]:
    """For each batch its number and (id, words of a window, repetition, signature, ``hits``' own find) of the windows that ``hits`` chooses.

    ``hits`` gets a repetition and the signatures of many windows, and gives the places it wants with something about each.
    """
    hasher = Hasher()
    for n, b in enumerate(batches):
        out = []
        for ids, ws, ends in _gathered(b.column(0).to_pylist(), b.column(1), window):
            h = hasher(ws)
            for start in range(0, len(ws) - window + 1, CHUNK):
                sig = signatures(h[start : start + CHUNK + window - 1], window, repeats, samples)
                for k in range(repeats):
                    for w, what in hits(k, sig[:, k]):
                        at = start + w
                        d = int(np.searchsorted(ends, at, side="right"))
                        if at + window <= ends[d]:  # else the window runs into the next document
                            out.append((ids[d], ws[at : at + window], k, int(sig[w, k]), what))
        yield n, out


_FOUND = "doc_id bigint, item_id bigint, edits int"


def _pairs_batch(found: dict[tuple, int]) -> pa.RecordBatch:
    keys = list(found)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(found.values()), pa.int32())], ["doc_id", "item_id", "edits"])


def _scan(docs: DataFrame, items: list[tuple], window: int, edits: int, repeats: int, samples: int) -> DataFrame:
    """Documents against few items, which all tasks hold."""
    shared, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _kept_index(key, shared.value, window, repeats, samples)

        def hits(k: int, sig: np.ndarray) -> Iterator[tuple[int, int]]:
            known = index[0][k][0]
            lo = np.searchsorted(known, sig)
            for w in np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == sig) if len(known) else ():
                yield int(w), int(lo[w])

        for _, windows in _windows(batches, window, repeats, samples, hits) if index else ():
            found: dict[tuple, int] = {}
            for doc, ws, k, sig, e in windows:
                known, owner, place = index[0][k]
                while e < len(known) and known[e] == sig:
                    i, p = int(owner[e]), int(place[e])
                    pair = (doc, index[2][i])
                    if found.get(pair, edits + 1) > 0:
                        apart = edit_distance(ws, index[1][i][p : p + window], edits)
                        if apart <= edits:
                            found[pair] = min(apart, found.get(pair, apart))
                    e += 1
            yield _pairs_batch(found)

    return docs.select("doc_id", "text").mapInArrow(run, _FOUND)


_SIGNED = "id bigint, words string, repeat int, sig bigint"


def _signed(rows: DataFrame, window: int, repeats: int, samples: int, bitmap=None) -> DataFrame:
    """id, words, repeat, sig of the windows of ``rows`` (id, text); with a ``bitmap`` only of those it may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)

        def hits(_: int, sig: np.ndarray) -> Iterator[tuple[int, None]]:
            if bits is None:
                return ((w, None) for w in range(len(sig)))
            at = sig & np.uint64(PARTS * 2**PART_BITS - 1)
            return ((int(w), None) for w in np.flatnonzero(bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1))

        for _, windows in _windows(batches, window, repeats, samples, hits):
            sig = np.array([w[3] for w in windows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([w[0] for w in windows], pa.int64()), pa.array([" ".join(w[1]) for w in windows], pa.string()), pa.array([w[2] for w in windows], pa.int32()), pa.array(sig, pa.int64())], ["id", "words", "repeat", "sig"])

    return rows.mapInArrow(run, _SIGNED)


def _bitmap(signed: DataFrame) -> bytes:
    """The low bits of all signatures, as a bitmap of fixed size: each part comes from a bounded number of distinct places."""
    low = F.col("sig").bitwiseAND(F.lit(PARTS * 2**PART_BITS - 1))
    places = signed.select(F.shiftright(low, PART_BITS).cast("int").alias("part"), low.bitwiseAND(F.lit(2**PART_BITS - 1)).cast("int").alias("bit")).distinct()

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(2**PART_BITS, np.uint8)
        bits[table.column("bit").to_numpy()] = 1
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = {r["part"]: bytes(r["bits"]) for r in places.groupBy("part").applyInArrow(fill, "part int, bits binary").collect()}
    return b"".join(parts.get(k, bytes(2**PART_BITS // 8)) for k in range(PARTS))


def _join(docs: DataFrame, items: DataFrame, window: int, edits: int, repeats: int, samples: int) -> DataFrame:
    """Documents against any number of items, by a join of signatures."""
    signed = materialise(_signed(items.select("item_id", "text"), window, repeats, samples).distinct(), "leakage-items")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(signed))
    ours = _signed(docs.select("doc_id", "text"), window, repeats, samples, bitmap).select(F.col("id").alias("doc_id"), F.col("words").alias("doc_words"), "repeat", "sig", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    theirs = signed.select(F.col("id").alias("item_id"), F.col("words").alias("item_words"), "repeat", "sig", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = ours.join(theirs, ["repeat", "sig", "salt"]).select("doc_id", "item_id", "doc_words", "item_words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple, int] = {}
            for doc, item, x, y in zip(*(b.column(k).to_pylist() for k in range(4))):
                if found.get((doc, item), edits + 1) > 0:
                    apart = edit_distance(x.split(" "), y.split(" "), edits)
                    if apart <= edits:
                        found[doc, item] = min(apart, found.get((doc, item), apart))
            yield _pairs_batch(found)

    return met.mapInArrow(verify, _FOUND)


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW, edits: int = 0, recall: float = 0.95, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """doc_id, item_id, edits (the fewest found) of every document that holds a passage of an item.

    A passage is ``window`` consecutive words, at most ``edits`` word edits apart. A
    document or item with a NULL id is left out.
    """
    asked = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    samples = SAMPLES if edits == 0 else SAMPLES_NEAR
    repeats = repetitions(window, edits, recall, samples)
    docs = docs.where(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * window - 1))
    # A word and what parts it from the next take two characters at least.
    most_words = (asked.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // 2
    if most_words <= broadcast_words:
        pairs = _scan(docs, [(r[0], r[1]) for r in asked.collect()], window, edits, repeats, samples)
    else:
        pairs = _join(docs, asked, window, edits, repeats, samples)
    return pairs.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
