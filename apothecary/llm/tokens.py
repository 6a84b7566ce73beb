"""Token ids of a whole corpus by a public byte-level tokenizer, with offsets and decoding.

Texts pass through the tokenizers library in Arrow batches, a bounded number of
characters at a time. Defined cases: empty and NULL texts have an empty list; white
space is kept; the strings of special tokens are ordinary text; unknown ids decode to
nothing; a slice of ids that cuts a character gives U+FFFD for its pieces.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from types import ModuleType

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public vocabularies; a parameter of every operator. Where a node lacks the file, the
#: one of the same name is taken that was sent with the job (``SparkContext.addFile``).
VOCABULARIES = os.environ.get("APOTHECARY_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.json"
CHARS_AT_ONCE = 200_000


def load(path: str):
    """The tokenizer of a file, once a worker process, without threads of its own."""
    kept = sys.modules.setdefault("_apothecary_tokenizers", ModuleType("_apothecary_tokenizers")).__dict__
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
        tokenizer.encode_special_tokens = True
        kept[path] = tokenizer
    return kept[path]


def byte_table() -> dict[str, int]:
    """Character to byte of byte-level vocabularies: printable bytes stand for themselves, the rest for U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def decoder(path: str):
    """A function from ids to text by the reversed byte table."""
    table = byte_table()
    pieces = {i: bytes(table[c] for c in token) for token, i in load(path).get_vocab(with_added_tokens=False).items() if all(c in table for c in token)}
    return lambda ids: b"".join(pieces.get(i, b"") for i in ids).decode("utf-8", "replace")


def _slices(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of bounded total length; a longer text stands alone."""
    start = chars = 0
    for i, t in enumerate(texts):
        if i > start and chars + len(t) > CHARS_AT_ONCE:
            yield texts[start:i]
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield texts[start:]


def _encoded(texts: list[str], path: str, offsets: bool = False) -> Iterator:
    tokenizer = load(path)
    encode = tokenizer.encode_batch if offsets or not hasattr(tokenizer, "encode_batch_fast") else tokenizer.encode_batch_fast
    for part in _slices(texts):
        yield from encode(part, add_special_tokens=False)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """id_col and ``ids`` of each row."""
    path = path or f"{VOCABULARIES}/{BYTE_BPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = pa.array([e.ids for e in _encoded(_texts(b), path)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, "ids"])

    return df.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def encode_offsets(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """id_col, ``ids`` and the character ranges ``starts`` and ``ends`` of each token."""
    path = path or f"{VOCABULARIES}/{BYTE_BPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(e.ids, [o[0] for o in e.offsets], [o[1] for o in e.offsets]) for e in _encoded(_texts(b), path, True)]
            lists = [pa.array([r[k] for r in rows], pa.list_(pa.int32())) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *lists], [id_col, "ids", "starts", "ends"])

    return df.select(id_col, F.col(text_col)).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>")


def covered(offsets: DataFrame, id_col: str) -> DataFrame:
    """id_col and ``chars``: how many characters the ranges of all its tokens hold together, those of several tokens once.

    Ranges come in order of the text, so one pass over them suffices; a gap counts as not covered.
    """
    ranges = F.arrays_zip("starts", "ends")
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("chars"))
    step = lambda a, r: F.struct(F.greatest(a["upto"], r["ends"]).alias("upto"), (a["chars"] + F.greatest(F.lit(0), r["ends"] - F.greatest(a["upto"], r["starts"]))).alias("chars"))
    return offsets.select(id_col, F.aggregate(ranges, start, step, lambda a: a["chars"]).cast("bigint").alias("chars"))


def decode(df: DataFrame, id_col: str, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """id_col and the ``text`` its ids stand for."""
    path = path or f"{VOCABULARIES}/{BYTE_BPE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = decoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text(x or []) for x in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    return df.select(id_col, F.col(ids_col)).mapInArrow(run, f"{id_col} {df.schema[id_col].dataType.simpleString()}, text string")
