"""Quality rules whose cutoffs bound the share of good documents they reject.

A rule rejects a document when one of its measures exceeds a cutoff. For every
stratum (language, say) and rule, cutoffs are tried from the most lenient to
stricter ones on labelled documents. A cutoff is certified when, were its true
false-rejection rate as high as allowed, so few rejections of good labelled
documents would have a binomial probability below the level: an exact
(Clopper-Pearson) bound. Testing stops at the first cutoff that fails, so the
fixed order needs no correction of its own; the level is divided by the number
of strata times rules (Bonferroni). With probability ``confidence`` all rules of
all strata together therefore keep their limits, and a stratum's rules reject
``max_false_rejection`` of its good documents at most, since each rule has its
share of that. Of the certified cutoffs, the one that rejects most bad labelled
documents is used, where a good one counts ``good_weight`` times; if none gains
anything, or a stratum has too few labels, the rule does not apply there.

Null texts have no words. Null strata are the stratum "". Labels without a
quality are left out; a document labelled twice is good if any label says so.
Rows that repeat a key are judged each, and each counts as labelled. Without
labels only the base rule holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import text_of, trimmed
from topicloom.session import materialize

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_FIELDS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
    "n_small",
    "n_bangs",
)
_KIND = "struct<" + ",".join(f"{f}:long" for f in _FIELDS) + ">"
_ARROW_KIND = pa.struct([(f, pa.int64()) for f in _FIELDS])

# Measure and most lenient cutoff of each rule; the others follow by RATIO.
RULES = {
    "symbols": ("n_symbols", "n_words", 4.0),
    "dup_lines": ("n_dup_lines", "n_lines", 0.95),
    "repeats": ("n_repeat_words", "n_words", 0.95),
    "capitals": ("n_capitals", "n_letters", 0.95),
    "word_length": ("word_chars", "n_words", 40.0),
    "bangs": ("n_bangs", "n_words", 4.0),
}
RATIO = 0.8
CUTOFFS = 16


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside a window of ``size`` words that the text has twice or more."""
    if len(words) <= size:
        return 0
    local: dict[bytes, int] = {}
    ids = np.array([local.setdefault(w, len(local)) for w in words], dtype=np.int64)
    count = len(words) - size + 1
    window = ids[:count]
    for i in range(1, size):
        if i > 1:
            window = np.unique(window, return_inverse=True)[1]
        window = window * len(local) + ids[i : i + count]
    _, inverse, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    hit = np.zeros(len(words), dtype=bool)
    for i in range(size):
        hit[i : i + count] |= twice
    return int(hit.sum())


def measure(text: str) -> tuple[int, ...]:
    """The measures of a text, in the order of their fields."""
    data = text.encode()
    words = data.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    codes = np.frombuffer(data, np.uint8)
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        int(np.count_nonzero((codes >= 65) & (codes <= 90))),
        int(np.count_nonzero((codes >= 97) & (codes <= 122))),
        text.count("!"),
    )


@trimmed
def _measures(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in texts:
        parts = (values.slice(at, 500).to_pylist() for at in range(0, len(values), 500))
        rows = np.array([measure(t) for part in parts for t in part], dtype=np.int64)
        rows = rows.reshape(len(values), len(_FIELDS))
        yield pa.StructArray.from_arrays([pa.array(c) for c in rows.T], fields=list(_ARROW_KIND))


def measures(text: str = "text") -> Column:
    """All measures of a text column, as a struct."""
    return F.arrow_udf(_measures, _KIND)(text_of(text))


def base_failed(measured: str = "measured") -> Column:
    words, repeats = F.col(f"{measured}.n_words"), F.col(f"{measured}.n_repeat_words")
    return (words < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * words)


def cutoffs(top: float) -> list[float]:
    """From the most lenient on."""
    return [top * RATIO**i for i in range(CUTOFFS)]


def _ratio(name: str, measured: str) -> Column:
    over, under, _ = RULES[name]
    if under == "n_letters":
        base = F.col(f"{measured}.n_capitals") + F.col(f"{measured}.n_small")
    else:
        base = F.col(f"{measured}.{under}")
    return F.when(base > 0, F.col(f"{measured}.{over}") / base).otherwise(0.0)


def _exceeded(measured: str) -> Column:
    """For each rule, how many of its cutoffs the document exceeds."""
    return F.array(
        *[
            sum(F.when(_ratio(name, measured) > c, 1).otherwise(0) for c in cutoffs(top))
            for name, (_, _, top) in RULES.items()
        ]
    )


def tail(rejected: int, good: int, rate: float) -> float:
    """Probability of ``rejected`` or fewer among ``good`` at the given rate."""
    if rate <= 0 or good == 0:
        return 1.0
    if rejected >= good:
        return 1.0
    logs = [
        math.lgamma(good + 1)
        - math.lgamma(i + 1)
        - math.lgamma(good - i + 1)
        + i * math.log(rate)
        + (good - i) * math.log1p(-rate)
        for i in range(rejected + 1)
    ]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose_cutoff(
    good: list[int], bad: list[int], rate: float, level: float, good_weight: float
) -> int:
    """How many cutoffs a document must exceed to be rejected, from documents
    counted by that number (0 to CUTOFFS); CUTOFFS + 1 if no cutoff is used.

    Cutoff ``j`` (from 0, the most lenient) is exceeded by documents that exceed
    ``CUTOFFS - j`` cutoffs from the strict end, i.e. that count or more.
    """
    n_good, n_bad = sum(good), sum(bad)
    best, gain = CUTOFFS + 1, 0.0
    for need in range(CUTOFFS, 0, -1):
        lost, caught = sum(good[need:]), sum(bad[need:])
        if tail(lost, n_good, rate) > level:
            break
        value = caught / max(1, n_bad) - good_weight * lost / max(1, n_good)
        if value > gain:
            best, gain = need, value
    return best


def fit(
    labelled: DataFrame,
    max_false_rejection: float = 0.06,
    confidence: float = 0.95,
    good_weight: float = 50.0,
) -> DataFrame:
    """``stratum, needs``: how many cutoffs of each rule reject, from a table of
    ``stratum, measured, quality`` whose documents pass the base rule."""
    counts = materialize(
        labelled.select("stratum", "quality", F.posexplode(_exceeded("measured")).alias("rule", "level"))
        .groupBy("stratum", "quality", "rule", "level")
        .agg(F.count("*").alias("n")),
        "rule-counts",
    )
    strata = counts.select("stratum").distinct().count()
    level = (1 - confidence) / max(1, strata * len(RULES))
    rate = max_false_rejection / len(RULES)
    rules = len(RULES)

    @F.arrow_udf("array<int>")
    def needs(groups: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in groups:
            out = []
            for cells in values.to_pylist():
                table = np.zeros((rules, 2, CUTOFFS + 1), dtype=np.int64)
                for c in cells:
                    table[c["rule"], c["quality"], c["level"]] = c["n"]
                out.append(
                    [
                        choose_cutoff(t[1].tolist(), t[0].tolist(), rate, level, good_weight)
                        for t in table
                    ]
                )
            yield pa.array(out, pa.list_(pa.int32()))

    # A stratum has rules x 2 x (CUTOFFS + 1) cells at most.
    cells = F.collect_list(F.struct("rule", "quality", "level", "n"))
    return counts.groupBy("stratum").agg(cells.alias("cells")).select("stratum", needs("cells").alias("needs"))


def _labels(labels: DataFrame, key: str, quality: str) -> DataFrame:
    good = (F.col(quality) > 0).cast("int")
    return (
        labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("label_key"))
        .agg(F.max(good).alias("quality"))
    )


def fit_on(
    measured: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", **limits: float
) -> DataFrame:
    """:func:`fit` from a table of ``label_key, stratum, measured`` and the labels;
    stored, as it is small and joined to every document."""
    held = measured.where(~base_failed()).join(_labels(labels, key, quality), "label_key")
    return materialize(fit(held, **limits), "cutoffs")


def rejected(measured: str = "measured", needs: str = "needs") -> Column:
    """Whether any rule rejects; false where no rule applies."""
    over = F.zip_with(_exceeded(measured), F.col(needs), lambda level, need: level >= need)
    return F.coalesce(F.exists(over, lambda x: x), F.lit(False))


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to a table of ``stratum, measured``."""
    failed = base_failed()
    return (
        measured.join(cuts, "stratum", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~rejected())
        .drop("needs")
    )


def measured_table(
    docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang"
) -> DataFrame:
    """``label_key, stratum, measured`` of every document, without its text."""
    return docs.select(F.col(key).alias("label_key"), text_of(stratum).alias("stratum"), measures(text).alias("measured"))


def quality_report(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **limits: float
) -> DataFrame:
    """``key``, the base measures, ``base_failed`` and ``kept`` of every document."""
    measured = materialize(measured_table(docs, key, text, stratum), "measures")
    judged = judge(measured, fit_on(measured, labels, key, **limits))
    base = [F.col(f"measured.{f}").alias(f) for f in _FIELDS[:5]]
    return judged.select(F.col("label_key").alias(key), *base, "base_failed", "kept")


def keep_good(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", **limits: float
) -> DataFrame:
    """The documents that the rules keep, with their columns as they are. Texts are
    measured a second time rather than joined to the verdicts by key, which would
    shuffle them."""
    measured = materialize(measured_table(docs, key, text, stratum), "measures")
    cuts = fit_on(measured, labels, key, **limits)
    rows = docs.select(
        F.struct("*").alias("row"), text_of(stratum).alias("stratum"), measures(text).alias("measured")
    )
    return judge(rows, cuts).where("kept").select("row.*")
