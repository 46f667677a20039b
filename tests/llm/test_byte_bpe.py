"""Byte-level BPE by the tokenizers library against tiktoken itself."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken

from tests.llm.conftest import as_rows, rows
from topicloom.llm import byte_bpe
from topicloom.llm.queries import QUERIES, vocabulary

RANKS = vocabulary("byte_bpe_multi_50k.tiktoken")


def reference():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_against_tiktoken(spark, corpus):
    got = sorted(as_rows(QUERIES["op12_byte_bpe"](spark, corpus["full"])), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    enc = reference()
    want = []
    for r in rows():
        ids = enc.encode_ordinary(r[1] or "")
        data = np.asarray(ids, dtype="<u4").tobytes()
        want.append((r[0], len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[2]))


def test_odd_texts_and_offsets(spark):
    texts = ["<|endoftext|> is text", "\x1c odd \x85 spaces \xa0　x", "a  b\r\n\r\n\t", "€𝄞 split", "", None, "z" * 20000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, with_offsets=True).collect()}
    enc = reference()
    for i, t in enumerate(texts):
        ids = list(np.frombuffer(got[i]["ids"], dtype="<u4"))
        assert ids == enc.encode_ordinary(t or "")
        assert len(got[i]["starts"]) == len(ids) and all(a <= b for a, b in zip(got[i]["starts"], got[i]["ends"], strict=True))
    back = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))


def test_split_characters_decode_in_pieces():
    enc = reference()
    ids = enc.encode_ordinary("𝄞€é and more €")
    whole = byte_bpe.decode_bytes(np.asarray(ids, dtype=np.uint32), RANKS)
    assert whole == "𝄞€é and more €".encode()
    parts = [np.asarray(ids[i : i + 1], dtype=np.uint32) for i in range(len(ids))]
    assert "".join(byte_bpe.decode_text(parts, RANKS)) == "𝄞€é and more €"
    assert byte_bpe.decode_bytes(np.zeros(0, dtype=np.uint32), RANKS) == b""


def test_byte_table_is_a_bijection():
    table = byte_bpe.byte_table()
    assert len(set(table)) == 256 and table[ord("a")] == "a" and table[32] == chr(256 + 32)


def test_both_paths_give_the_same_ids(spark, corpus):
    df = spark.read.parquet(f"{corpus['full']}/documents.parquet")
    fast = {(r[0], r[1]) for r in byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    whole = {(r[0], r[1]) for r in byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN, with_offsets=True).collect()}
    assert fast == whole
