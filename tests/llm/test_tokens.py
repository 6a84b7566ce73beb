"""Token ids: library agreement, exact round trip, offsets, defined empties."""

import os

import pytest

from apothecary.llm import tokens as K

PATH = f"{K.VOCABULARIES}/{K.BYTE_BPE}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no public vocabularies here")
TEXTS = ["Lot A failed.", "", None, "  two  blanks\t\n", "naïve Ünïcode 💊💊 नमूना", "<|endoftext|> is text", "a" * 50_000, "x\u0000y�", "Lot A failed."]


def frame(spark):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids string")


def test_ids_match_the_ranks(spark):
    import base64

    import tiktoken

    import public_tokenizers as P

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{K.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb"))}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in K.encode(frame(spark), "doc_id", "text").collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_round_trip_and_split_characters(spark):
    ids = K.encode(frame(spark), "doc_id", "text")
    assert {r["doc_id"]: r["text"] for r in K.decode(ids, "doc_id").collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    pill = next(r["ids"] for r in K.encode(spark.createDataFrame([(1, "💊")], "doc_id bigint, text string"), "doc_id", "text").collect())
    assert len(pill) > 1
    half = spark.createDataFrame([(1, pill[:1]), (2, []), (3, None), (4, [10**6])], "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in K.decode(half, "doc_id").collect()} == {1: "�", 2: "", 3: "", 4: ""}


def test_offsets_cover_the_text(spark):
    for r in K.encode_offsets(frame(spark), "doc_id", "text").collect():
        text = TEXTS[r["doc_id"]] or ""
        assert len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        covered = {p for a, b in zip(r["starts"], r["ends"]) for p in range(a, b)}
        assert covered == set(range(len(text)))


def test_byte_table_and_empty(spark):
    table = K.byte_table()
    assert len(table) == 256 and sorted(table.values()) == list(range(256))
    assert K.encode(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_ranges_cover_the_text(spark):
    got = {r["doc_id"]: r["chars"] for r in K.covered(K.encode_offsets(frame(spark), "doc_id", "text"), "doc_id").collect()}
    assert got == {i: len(t or "") for i, t in enumerate(TEXTS)}
    gaps = spark.createDataFrame([(1, [0, 3], [2, 5]), (2, [0, 0, 1], [1, 1, 4]), (3, [], [])], "k int, starts array<int>, ends array<int>")
    assert {tuple(r) for r in K.covered(gaps, "k").collect()} == {(1, 4), (2, 4), (3, 0)}


def test_vocabulary_sent_with_the_job(spark):
    spark.sparkContext.addFile(PATH)
    sent = K.encode(frame(spark), "doc_id", "text", f"/no/such/folder/{K.BYTE_BPE}")
    assert {r["doc_id"]: r["ids"] for r in sent.collect()} == {r["doc_id"]: r["ids"] for r in K.encode(frame(spark), "doc_id", "text").collect()}
