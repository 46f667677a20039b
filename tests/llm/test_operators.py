"""Parts of the operators, and tables with more and clashing columns."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import NOTICE, prose, rows
from topicloom.llm import decontaminate, jaccard, licenses, line_dedup, packing, quality, rans, tokens, url_filter
from topicloom.llm.queries import vocabulary

CLASHING = ["row", "found", "measured", "stratum", "spans", "run_text", "key", "scan_text", "node", "needs"]


@pytest.fixture(scope="module")
def wide(spark, corpus):
    """The documents with columns named like the operators' own."""
    docs = spark.read.parquet(f"{corpus['full']}/documents.parquet")
    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


ODD = [" ", "\n", "\t", "a", "É", "İ", "ς", "1", "½", "'s", "_", "-", ".", "́", "<|endoftext|>", "漢", "\x1c", "\x85", "\u3000", "\x0b", "word"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=20).map("".join))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_equal_the_library(name, text):
    encoder = test_tokens_equal_the_library.__dict__.setdefault(name, tokens.IdEncoder(vocabulary(name)))
    got = np.frombuffer(next(encoder.encode_all(pa.array([text]))), "<u4").tolist()
    assert got == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_memory_forgets_without_changing_results():
    texts = pa.array([prose(i, 300) for i in range(20)])
    small = tokens.IdEncoder(vocabulary("byte_bpe_50k.json"))
    small.memory = tokens.Memory(10)
    large = tokens.IdEncoder(vocabulary("byte_bpe_50k.json"))
    assert list(small.encode_all(texts)) == list(large.encode_all(texts))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_packing_uses_every_piece_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    for length, count in histogram.items():
        assert sum(c * dict(p).get(length, 0) for p, c in patterns) == count
    assert all(sum(n * t for n, t in p) <= 64 for p, _ in patterns)
    ranks = {}
    for length, low, high, times, *_ in packing.slots(patterns):
        assert low == ranks.get(length, 0) and (high - low) % times == 0
        ranks[length] = high
    assert ranks == histogram


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 3 * rans.LANES * rans.CHECKPOINT), st.integers(1, 3000), st.integers(0, 99))
def test_rans_round_trip(size, symbols, seed):
    rng = np.random.default_rng(seed)
    ids = (symbols * rng.random(size) ** 3).astype(np.int64)
    counts = np.bincount(ids, minlength=1)
    freqs = rans.scale(counts)
    assert not size or freqs.sum() == 1 << rans.PRECISION and (freqs[counts > 0] > 0).all()
    table = rans.Table(np.flatnonzero(counts), freqs[counts > 0])
    lengths = [size // 3, size - size // 3]
    payload = rans.encode_block(lengths, ids, table)
    got_lengths, got = rans.decode_block(payload, table)
    assert got_lengths.tolist() == lengths and (got == ids).all()


def test_rans_damage_is_seen():
    ids = np.arange(1000) % 7
    table = rans.Table(np.arange(7), rans.scale(np.bincount(ids)))
    payload = bytearray(rans.encode_block([1000], ids, table))
    payload[-1] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        rans.decode_block(bytes(payload), table)


def test_rans_many_rare_symbols():
    counts = np.ones(49_000, dtype=np.int64)
    counts[5] = 10**9
    freqs = rans.scale(counts)
    assert freqs.sum() == 1 << rans.PRECISION and freqs.min() == 1


def test_sequences_join_the_pieces(spark, corpus):
    docs = spark.read.parquet(f"{corpus['full']}/documents.parquet")
    packed = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), with_ids=True)
    total = packed.agg(F.sum("length")).first()[0]
    assert packing.sequences(packed).agg(F.sum(F.length("ids"))).first()[0] == 4 * total


def test_automaton_blocks_agree(spark, corpus):
    docs = spark.read.parquet(f"{corpus['full']}/documents.parquet")
    bench = spark.read.parquet(f"{corpus['full']}/benchmark.parquet")
    read = lambda d: sorted((str(r.row.doc_id), r.scan_text, str(r.found)) for r in d.collect())
    assert read(decontaminate.overlaps(docs, bench)) == read(decontaminate.overlaps(docs, bench, block_words=15))


def test_spans_are_cut_out():
    text = "Keep this. Cut THESE, words\nkeep the rest."
    assert decontaminate.without_spans(text, [(2, 5)]) == "Keep this. \nkeep the rest."
    assert decontaminate.without_spans(text, [(0, 8)]) == ""


def test_short_items_are_cut_out(spark):
    items = spark.createDataFrame([(1, "Who wrote Faust?"), (2, "Zanzibar"), (3, " ".join(f"w{i}" for i in range(12)))], "item_id long, text string")
    texts = ["Some of these ask who wrote Faust, and others do not.", "zanzibar is far away", "Zanzibar", "no item", "x " * 12 + " ".join(f"w{i}" for i in range(10)) + " y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items).collect()}
    assert got == {0: "Some of these ask and others do not.", 1: "is far away", 3: texts[3], 4: "x " * 12 + "y"}


def test_exact_binomial_bound():
    # No rejection among n: (1 - rate) ** n.
    assert quality.tail(0, 100, 0.02) == pytest.approx(0.98**100)
    assert quality.tail(100, 100, 0.02) == 1
    whole = sum(quality.tail(k, 30, 0.1) - (quality.tail(k - 1, 30, 0.1) if k else 0) for k in range(31))
    assert whole == pytest.approx(1)


def test_cutoffs_keep_good_documents():
    none = [0] * (quality.CUTOFFS + 1)
    good, bad = none.copy(), none.copy()
    good[0], bad[quality.CUTOFFS] = 1000, 50
    assert quality.choose_cutoff(good, bad, 0.01, 0.01, 50) == quality.CUTOFFS
    good[quality.CUTOFFS] = 30  # the rule would reject 3 % of the good ones
    assert quality.choose_cutoff(good, bad, 0.01, 0.01, 50) == quality.CUTOFFS + 1
    assert quality.choose_cutoff(none, bad, 0.01, 0.01, 50) == quality.CUTOFFS + 1


def test_quality_rules_reject_by_stratum(spark):
    rng = random.Random(1)
    plain = [(i, prose(i, 70), "en") for i in range(800)]
    loud = [(1000 + i, " ".join(f"{w}{rng.choice('#*$')}{rng.choice('#*$')}{rng.choice('%&|')}" for w in prose(i, 70).split()), "en") for i in range(60)]
    docs = spark.createDataFrame(plain + loud + [(5000, loud[0][1], "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, *_ in plain + loud], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in quality.quality_report(docs, labels).collect()}
    assert all(kept[i] for i, *_ in plain) and not any(kept[i] for i, *_ in loud)
    assert kept[5000]  # a stratum without labels


def test_banding_reaches_the_recall():
    bands, rows_ = jaccard.choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows_) ** bands >= 0.9999 and bands * rows_ <= jaccard.MAX_HASHES
    with pytest.raises(ValueError, match="recall"):
        jaccard.choose_bands(0.01, 0.9999, 10)


def test_near_copies_over_many_blocks(spark):
    base = prose(7, 120).split()
    texts = [" ".join([*base[:i], f"changed{i}", *base[i + 1 :]]) for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = sorted(tuple(r) for r in jaccard.jaccard_join(docs).collect())
    assert whole == sorted(tuple(r) for r in jaccard.jaccard_join(docs, block=7).collect())
    assert {w[2] for w in whole} == {0}


def test_connected_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    got = {r.node: r.root for r in jaccard.connected(edges).collect()}
    assert got == {i: 0 for i in range(1, 31)} | {51: 50}


@pytest.mark.parametrize("share", [1.0, 0.85])
def test_notices_are_found(spark, share):
    words = NOTICE.split()
    notices = [("GPL-3.0", NOTICE), ("long", " ".join(prose(3, 60).split()))]
    changed = prose(3, 60).split()
    if share < 1:
        changed[0] = "other"
    docs = spark.createDataFrame(
        [(1, "before " * 33 + " ".join(words) + " after"), (2, " ".join(["x"] * 7 + changed)), (3, None), (4, "two words")],
        "doc_id long, text string",
    )
    got = {(r.doc_id, r.license): (r.start, r.containment) for r in licenses.license_scan(docs, notices).collect()}
    assert got[1, "GPL-3.0"] == (33, 1.0) and set(got) == {(1, "GPL-3.0"), (2, "long")}
    assert got[2, "long"][1] >= 0.8
    with pytest.raises(ValueError, match="fewer"):
        licenses.Scanner([("x", "too short")], 5, 0.8, 0.99)


def test_op7_query(spark, corpus):
    from topicloom.llm.queries import QUERIES

    got = QUERIES["op7_license_scan"](spark, corpus["full"]).collect()
    want = [r[0] for r in rows() if r[1] and NOTICE in r[1]]
    assert [r.doc_id for r in got] == want and got[0].excerpt == NOTICE[:-1]


def test_winnowing_guarantee():
    rng = np.random.default_rng(3)
    for _ in range(50):
        run, words = rng.integers(0, 2**60, 12).astype(np.uint64), rng.integers(2, 12, 12)
        prints = []
        for _ in range(2):
            edge = [rng.integers(0, 2**60, rng.integers(0, 6)).astype(np.uint64) for _ in range(2)]
            lines = np.concatenate([edge[0], run, edge[1]])
            counts = np.concatenate([rng.integers(2, 12, len(edge[0])), words, rng.integers(2, 12, len(edge[1]))])
            prints.append({h for h, *_ in line_dedup.fingerprints(lines, counts, 20, 40)})
        assert words.sum() < 40 or prints[0] & prints[1]


def test_later_runs_go(spark):
    passage = prose(11, 60) + "."
    texts = [passage + " One tail.", "A head here. " + passage + " Another tail.", passage, "short one", None, passage + " " + passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.cleaned.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got[0] == texts[0] and got[1] == "A head here. Another tail." and got[2] == ""
    assert got[3] == "short one" and got[4] == "" and got[5].strip() == ""
    kept = {r.doc_id: r.text for r in line_dedup.without_repeats(docs).collect()}
    assert set(kept) == {0, 1, 3, 4} and kept[4] is None


def test_repeats_meet_a_place_that_holds_them(spark):
    # A has each 20 words of the passage, but not the passage; B and C have all of it.
    line = [" ".join(f"w{i}x{j}" for j in range(22)) + "." for i in range(4)]
    part = [line[i] + f" between {i} stands something else." for i in range(4)]
    whole = " ".join(line[:2])
    texts = [" ".join(part), "One head. " + whole + " One tail.", "Other head. " + whole + " Other tail."]
    # The short line after a window of the first place is in the second place only.
    long = " ".join(f"v{j}" for j in range(45)) + "."
    texts += [long + " Unlike that.", "A " + long + " And so on.", long + " And so on.", long + " And so on. End."]
    # Every line one more time, in one text.
    texts += [" ".join(["Again and again and again."] * 30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: r.cleaned.text for r in line_dedup.dedup_lines(docs).collect()}
    assert [got[i] for i in (0, 1, 3, 4)] == [texts[i] for i in (0, 1, 3, 4)]
    assert got[2] == "Other head. Other tail."
    assert got[5] == "And so on." and got[6] == "End."
    assert got[7].strip() == "Again and again and again."


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=24), min_size=2, max_size=2), st.lists(st.integers(1, 30), min_size=6, max_size=6))
def test_windows_cover_every_repeated_run(lines, words):
    hashes = [np.array(x, np.uint64) for x in lines]
    counts = [np.array([words[i] for i in x], np.int64) for x in lines]
    prints = [{h for h, *_ in line_dedup.fingerprints(h, w, 20, 40)} for h, w in zip(hashes, counts, strict=True)]
    shared = np.array(sorted(prints[0] & prints[1]), np.uint64)
    found = []
    for h, w in zip(hashes, counts, strict=True):
        windows = line_dedup.windows_of(h, w, 40)
        met = line_dedup.with_gram(h, w, 20, shared, *windows[1:])
        found.append([(x, a, b) for x, a, b in zip(*(c[met].tolist() for c in windows), strict=True)])
    earlier = {x for x, *_ in found[0]}
    gone = {i for x, a, b in found[1] if x in earlier for i in range(a, b)}
    runs = lambda x: {(a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1) if sum(words[i] for i in x[a:b]) >= 40}
    have = {tuple(lines[0][a:b]) for a, b in runs(lines[0])}
    assert gone == {i for a, b in runs(lines[1]) if tuple(lines[1][a:b]) in have for i in range(a, b)}


def test_words_of_a_host():
    found = [(0, 5, 100), (5, 6, 50), (0, 3, 5)]
    assert url_filter.best_cut("stonegarden", found, 1000) == ["stone", "garden"]
    assert url_filter.best_cut("zq", [], 1000) == ["zq"]


def test_last_labels_and_short_words_of_urls_count(spark):
    urls = ["http://stonegarden.xxx/", "http://river.Casino:8080/a", "http://windowlight.org/qq/", "http://windowlight.org/", "http://qq.paper.org/"]
    urls += [f"http://{h}.com/{p}/" for h in ("stonegarden", "windowlight", "paper") for p in ("en", "de")] + ["http://example.com/en/", "http://paper.net/en/"]
    pages = spark.createDataFrame([(i, u, "stone garden window light paper river") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, block_words=[*url_filter.BLOCK_WORDS, "qq"]).collect()}
    assert [got[i].verdict for i in range(5)] == ["block", "block", "block", "allow", "block"]
    # In a path's middle, too; and short words are learned there.
    got = url_filter.filter_urls(
        spark.createDataFrame([(i, u, "x") for i, u in enumerate(["http://a.org/z/qq/1", "http://a.net/1/vv/", "http://b.net/2/vv/", "http://c.com/3/ww/"])], pages.schema),
        rules=[("block", "net", "/1/"), ("allow", "com", "/")], block_words=["qq"],
    )
    got = {r.page_id: r.score for r in got.collect()}
    assert got[0] > 0.5 and got[2] > 0.5


@pytest.mark.parametrize(
    "clean",
    [
        lambda d, s, c: quality.keep_good(d, s.read.parquet(f"{c}/labels.parquet")),
        lambda d, s, c: line_dedup.without_repeats(d),
        lambda d, s, c: jaccard.one_of_each_group(d),
        lambda d, s, c: decontaminate.decontaminate(d, s.read.parquet(f"{c}/benchmark.parquet")),
    ],
)
def test_other_columns_stay(spark, corpus, wide, clean):
    out = clean(wide, spark, corpus["full"])
    assert out.columns == wide.columns
    for r in out.collect():
        assert [r[c] for c in CLASHING] == list(range(len(CLASHING)))


def test_counts_ignore_other_columns(spark, wide):
    from topicloom.llm import katz, token_counts

    assert token_counts.token_counts(wide, vocabulary("byte_bpe_50k.json")).count() == len(rows())
    assert katz.katz_scores(wide, F.lit(True)).count() == len(rows())
    assert packing.pack_documents(wide, vocabulary("byte_bpe_50k.json")).select("doc_id").distinct().count() > 50
    assert jaccard.jaccard_join(wide).count() == len(rows())
    assert licenses.license_scan(wide).count() == 1


def test_lines_end_at_breaks_and_after_sentences():
    text = b'One.  "Two!" \tthree?\') four."\n\n five .\t six "seven. .'
    ended = [b"One.  ", b'"Two!" \t', b"three?\') four.\"\n", b"\n", b" five .\t ", b'six "seven. ', b"."]
    assert line_dedup.lines_of(text) == ended
    rng = np.random.default_rng(5)
    for _ in range(3000):
        text = bytes(rng.choice(list(b"a. \t\n!?\")']x"), rng.integers(0, 14)).tolist())
        lines = line_dedup.lines_of(text)
        assert b"".join(lines) == text
        # What a reading of the rule, byte by byte, gives.
        plain, at = [b""], 0
        while at < len(text):
            before = text[:at]
            sentence = before.endswith((b".", b"!", b"?")) or (
                before[-1:] in (b'"', b"'", b")", b"]") and before[:-1].endswith((b".", b"!", b"?"))
            )
            if text[at : at + 1] == b"\n":
                at += 1
                plain.append(b"")
            elif text[at] in b" \t" and sentence:
                while at < len(text) and text[at] in b" \t":
                    at += 1
                plain.append(b"")
            else:
                plain[-1] += text[at : at + 1]
                at += 1
        assert line_dedup.split_lines(text) == plain and len(lines) == len(plain)


def test_long_texts_make_their_own_powers():
    hashes = np.arange(9_000, dtype=np.uint64)
    starts = np.arange(4_500)
    whole = line_dedup.Runs(hashes).hashes(starts + 4_000, starts + 4_010)
    for at in (0, 90, 4_400):
        part = line_dedup.Runs(hashes[4_000 + at : 4_010 + at]).hashes(np.array([0]), np.array([10]))
        assert whole[at] == part[0]
