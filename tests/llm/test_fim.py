"""Fill-in-middle against a plain computation of the same contract."""

import hashlib
import re

from tests.llm.conftest import as_rows, rows
from topicloom.llm import fim
from topicloom.llm.queries import QUERIES

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        form, out = "plain", text
    elif h[3] % 100 < 80:
        form, out = "spm", "<S>" + suffix + "<P>" + prefix + "<M>" + middle
    else:
        form, out = "psm", "<P>" + prefix + "<S>" + suffix + "<M>" + middle
    restored = restore(out, form)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    chars = (None, None) if form == "plain" else (len(prefix), len(middle))
    return (doc_id, n, form, *chars, sha(out), sha(restored))


def restore(out, form):
    if form == "plain":
        return out
    parts = re.split(r"(<P>|<S>|<M>)", out)[1:]
    got = dict(zip(parts[::2], parts[1::2], strict=True))
    return got["<P>"] + got["<M>"] + got["<S>"]


def key(r):
    return (r[0] is None, r[0] or 0, r[5])


def test_query_against_brute_force(spark, corpus):
    got = as_rows(QUERIES["op13_fill_in_middle"](spark, corpus["full"]))
    want = [brute(r[0], r[1]) for r in rows()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert {g[2] for g in got} == {"plain", "psm", "spm"}
    assert all(b[6] == hashlib.sha256((r[1] or "").encode()).hexdigest() for r, b in zip(rows(), want, strict=True))


def test_long_texts_odd_keys_and_sentinels(spark, monkeypatch):
    monkeypatch.setattr(fim, "PIECE", 7)  # many pieces a text
    texts = ["x <P> y", "", None, "  lead and trail  ", "𝄞 é " * 50, "w " * 3000, " \n\t", "one"]
    data = [(i, t, "clash", 1) for i, t in enumerate(texts)] * 2 + [(None, "no key here at all", None, 0)]
    df = spark.createDataFrame(data, "doc_id long, text string, piece string, h long")
    for i in range(20):  # more keys, so that every form occurs
        data.append((100 + i, f"text {i} with some words to cut", None, 0))
    df = spark.createDataFrame(data, "doc_id long, text string, piece string, h long")
    got = as_rows(fim.fim_digests(df))
    want = [brute(d[0], d[1]) for d in data]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fim_digests(df).count() == 0


def test_oracle_sql_agrees(spark, corpus):
    import duckdb

    from topicloom.llm.queries import ORACLES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{corpus['full']}/documents.parquet')")
    want = [tuple(r) for r in con.execute(ORACLES["op13_fill_in_middle"]).fetchall()]
    got = as_rows(QUERIES["op13_fill_in_middle"](spark, corpus["full"]))
    assert sorted(got, key=key) == sorted(want, key=key)
