"""Text and token-array expressions. All are plain Spark columns except the
Porter2 stemmer, which stems each distinct token of an Arrow batch once, and
``letter_words``, which cuts the texts of a batch into words and stems at once."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions import porter2 as porter2_rules
from topicloom.functions.stopwords import ENGLISH

# The character classes tokens are made of.
LETTER_RUN = "[a-z_'-]+"
WORD_CHAR_RUN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?"
CONTRACTION = r"(n't|'(?:s|m|d|ll|re|ve)\b)"
WORD_OR_MARK = (
    r"n't|'(?:s|m|d|ll|re|ve)\b"
    r"|[\p{L}\p{N}_]+(?:[-'.][\p{L}\p{N}_]+|,[0-9]+)*"
    r"|[^\s\p{L}\p{N}_]"
)

Tokenizer = Callable[[Column], Column]

# Bytes of text whose words are cut and stemmed at once.
PIECE_BYTES = 8_000_000

# The stemmer travels inside the query, so executors need not have this package.
for _module in (sys.modules[__name__], porter2_rules):
    cloudpickle.register_pickle_by_value(_module)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def as_text(column: Column | str) -> Column:
    return _col(column).cast("string")


# ---------------------------------------------------------------- tokenizers


def sentence_tokens(text: Column | str, language: str = "en", country: str = "US") -> Column:
    """Words grouped by sentence, as an array of arrays."""
    return F.sentences(as_text(text), F.lit(language), F.lit(country))


def letter_tokens(text: Column | str) -> Column:
    """Lower-cased runs of letters, hyphens, underscores and apostrophes."""
    return F.regexp_extract_all(F.lower(as_text(text)), F.lit(LETTER_RUN), F.lit(0))


def word_tokens(text: Column | str) -> Column:
    """Lower-cased words; punctuation marks and clitics are tokens of their own."""
    spaced = F.regexp_replace(F.lower(as_text(text)), CONTRACTION, " $1")
    return F.regexp_extract_all(spaced, F.lit(WORD_OR_MARK), F.lit(0))


def word_char_tokens(text: Column | str) -> Column:
    """Lower-cased runs of word characters and inner hyphens, in any script."""
    return F.regexp_extract_all(F.lower(as_text(text)), F.lit(WORD_CHAR_RUN), F.lit(0))


TOKENIZERS: dict[str, Tokenizer] = {
    "letters": letter_tokens,
    "words": word_tokens,
    "wordchars": word_char_tokens,
}


# ------------------------------------------------------------- token filters


def keep_alpha(tokens: Column | str) -> Column:
    """Only tokens that contain a letter a-z."""
    return F.filter(_col(tokens), lambda t: t.rlike("[a-zA-Z]"))


def remove_stop_words(tokens: Column | str, words: Sequence[str] = ENGLISH) -> Column:
    """Drop stop words and keep repeats and order of the rest."""
    if not words:
        return _col(tokens)
    return F.filter(_col(tokens), lambda t: ~t.isin(list(words)))


def keep_words(tokens: Column | str, stop_words: Sequence[str] = ENGLISH) -> Column:
    """``keep_alpha`` and ``remove_stop_words`` in one pass over the tokens."""
    if not stop_words:
        return keep_alpha(tokens)
    return F.filter(_col(tokens), lambda t: t.rlike("[a-zA-Z]") & ~t.isin(list(stop_words)))


@cache
def _accent_table() -> tuple[str, str, str]:
    """Characters whose compatibility form is ASCII once marks are dropped: those
    that give one character, with it, and a JSON map of those that give more."""
    accented, plain, longer = [], [], {}
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            accented.append(char)
            plain.append(folded)
        elif folded:
            longer[char] = folded
    return "".join(accented), "".join(plain), json.dumps(longer)


def fold_accents(text: Column | str) -> Column:
    """The compatibility form of each character, as far as it is ASCII."""
    accented, plain, longer = _accent_table()
    text = as_text(text)
    single = F.translate(text, accented, plain)
    table = F.from_json(F.lit(longer), "map<string,string>")
    left = F.array_distinct(F.regexp_extract_all(single, F.lit(r"([^\x00-\x7F])"), F.lit(1)))
    folded = F.aggregate(
        left,
        single,
        lambda out, char: F.replace(out, char, F.coalesce(F.element_at(table, char), F.lit(""))),
    )
    return F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text)


# ------------------------------------------------------------------ stemming


def s_strip(token: Column | str) -> Column:
    """Harman's S-stemmer (1991): strip a plural ending from one token."""
    token = _col(token)

    def ends(*suffixes: str) -> Column:
        test = F.endswith(token, F.lit(suffixes[0]))
        for suffix in suffixes[1:]:
            test = test | F.endswith(token, F.lit(suffix))
        return test

    size = F.length(token)
    # Most tokens end otherwise and need one test only.
    return (
        F.when(~ends("s"), token)
        .when(
            ends("ies") & ~ends("eies", "aies"),
            F.concat(F.substring(token, F.lit(1), size - 3), F.lit("y")),
        )
        .when(ends("es") & ~ends("aes", "ees", "oes"), F.substring(token, F.lit(1), size - 1))
        .when(ends("s") & ~ends("us", "ss"), F.substring(token, F.lit(1), size - 1))
        .otherwise(token)
    )


def _stem_values(values: pa.Array) -> pa.Array:
    encoded = values.dictionary_encode()
    stems = pa.array([porter2_rules.stem(w) for w in encoded.dictionary.to_pylist()], pa.string())
    return stems.take(encoded.indices)


@F.arrow_udf(T.StringType())
def porter2(tokens: pa.Array) -> pa.Array:
    """English Snowball stem of a token column."""
    return _stem_values(tokens)


@F.arrow_udf(T.ArrayType(T.StringType()))
def porter2_array(tokens: pa.Array) -> pa.Array:
    """English Snowball stems of a token-array column."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *sizes.cumsum().tolist()], pa.int32())
    mask = tokens.is_null() if tokens.null_count else None
    return pa.ListArray.from_arrays(offsets, _stem_values(tokens.flatten()), mask=mask)


def stem_tokens(tokens: Column | str, stemmer: str = "porter2") -> Column:
    """Stems in token order, so that ``stems[i]`` belongs to ``tokens[i]``."""
    tokens = _col(tokens)
    if stemmer == "none":
        return tokens
    if stemmer == "s_strip":
        return F.transform(tokens, s_strip)
    if stemmer == "porter2":
        return porter2_array(tokens)
    raise ValueError(f"unknown stemmer {stemmer!r}")


# --------------------------------------------------- words and stems by batch

_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz_'-")] = True


def _s_strip_word(word: str) -> str:
    """``s_strip`` of one word."""
    if not word.endswith("s"):
        return word
    if word.endswith("ies") and not word.endswith(("eies", "aies")):
        return word[:-3] + "y"
    if word.endswith("es") and not word.endswith(("aes", "ees", "oes")):
        return word[:-1]
    return word if word.endswith(("us", "ss")) else word[:-1]


_WORD_STEMMERS: dict[str, Callable[[str], str]] = {
    "none": str,
    "s_strip": _s_strip_word,
    "porter2": porter2_rules.stem,
}


def _letter_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The matches of ``LETTER_RUN`` in all texts, and the number of those before each
    text and after the last. The class is ASCII, so no byte of another character is in it."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    kind = np.dtype(np.int64 if wide else np.int32)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * kind.itemsize).astype(np.int64)
    data = np.frombuffer(data if data is not None else b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds -= bounds[0]
    inside = _LETTER[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = bounds[bounds < len(data)]
    first[begins] = inside[begins]
    chars = data[inside]
    ends = np.append(np.flatnonzero(first[inside]), len(chars)).astype(kind)
    runs = (pa.LargeStringArray if wide else pa.StringArray).from_buffers(
        len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(chars)
    )
    return runs, np.searchsorted(np.flatnonzero(first), bounds)


def pieces(column: pa.Array) -> list[pa.Array]:
    """A column of texts, bytes or lists in pieces of about ``PIECE_BYTES``, a longer row in one of
    its own: the steps over a piece hold many numbers for each of its bytes."""
    listed = pa.types.is_list(column.type)
    sizes = pc.multiply(pc.list_value_length(column), 8) if listed else pc.binary_length(column)
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    piece = np.diff(ends, prepend=0)
    piece = (ends - piece) // PIECE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(column)]
    return [column.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def letter_words(
    text: Column | str,
    stop_words: Sequence[str] = ENGLISH,
    stemmer: str = "none",
    as_line: bool = False,
) -> Column:
    """``letter_tokens`` without those that ``keep_words`` drops, stemmed: what these give
    one after the other, for a batch of texts at a time. Each distinct word of a batch is
    judged and stemmed once. As a line, the words of a text are one string in which a space
    follows each: rows of few values, which are stored and read much faster than arrays."""
    if stemmer not in _WORD_STEMMERS:
        raise ValueError(f"unknown stemmer {stemmer!r}")
    stem, stops = _WORD_STEMMERS[stemmer], pa.array(list(stop_words), pa.string())

    def run(texts: pa.Array) -> pa.Array:
        parts = [words_of(part) for part in pieces(texts)]
        return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)

    def words_of(texts: pa.Array) -> pa.Array:
        runs, bounds = _letter_runs(texts)
        encoded = runs.dictionary_encode()
        found = encoded.dictionary
        keep = pc.and_not(
            pc.match_substring_regex(found, "[a-z]"), pc.is_in(found, value_set=stops.cast(found.type))
        ).to_numpy(zero_copy_only=False)
        places = encoded.indices.to_numpy()
        kept = keep[places]
        before = np.append(0, np.cumsum(kept))[bounds]
        stems = found.filter(pa.array(keep))
        if stem is not str:
            distinct = stems.to_numpy(zero_copy_only=False).tolist()
            stems = pa.array([stem(word) for word in distinct], found.type)
        if as_line:
            stems = pc.binary_join_element_wise(stems, pa.scalar("", found.type), " ")
        words = stems.take(pa.array((np.cumsum(keep, dtype=np.int32) - 1)[places[kept]]))
        nulls = texts.is_null() if texts.null_count else None
        if not as_line:
            return pa.ListArray.from_arrays(
                pa.array(before, pa.int32()), words.cast(pa.string()), mask=nulls
            )
        _, offsets, data = words.buffers()
        kind = np.int64 if pa.types.is_large_string(found.type) else np.int32
        offsets = np.frombuffer(offsets, kind, len(words) + 1)[before]
        lines = type(words).from_buffers(len(texts), pa.py_buffer(offsets), data)
        return lines if nulls is None else pc.if_else(nulls, pa.scalar(None, lines.type), lines)

    return F.arrow_udf(run, "string" if as_line else "array<string>")(F.lower(as_text(text)))


def line_words(lines: Column | str) -> Column:
    """The words of a line as an array."""
    words = F.split(_col(lines), " ")
    return F.slice(words, F.lit(1), F.size(words) - 1)


# ------------------------------------------------------------------- n-grams


def ngrams(tokens: Column | str, low: int = 1, high: int = 3) -> Column:
    """Space-joined runs of ``low`` to ``high`` tokens, shorter runs first.

    Each length is the previous one zipped with the shifted tokens, so the work
    is linear in the document length.
    """
    tokens = _col(tokens)
    size = F.size(tokens)
    runs, grams = [], tokens
    for n in range(1, high + 1):
        if n > 1:
            count = F.greatest(size - (n - 1), F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), count),
                F.slice(tokens, F.lit(n), count),
                lambda left, right: F.concat(left, F.lit(" "), right),
            )
        if n >= low:
            runs.append(grams)
    return F.concat(*runs) if len(runs) > 1 else runs[0]


def term_stems(term: Column | str) -> Column:
    """The stems an n-gram is made of."""
    return F.split(_col(term), " ")


def title_of(text: Column | str) -> Column:
    """First line of a text."""
    return F.split_part(as_text(text), F.lit("\n"), F.lit(1))
