"""The published English (Porter2) Snowball stemming rules, for one word."""

from __future__ import annotations

import re

# The rule tables of the published algorithm.
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
KEEP_AFTER_PLURAL = {
    "inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed",
}
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent",
    "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous",
    "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic",
    "ical": "ic", "ful": "", "ness": "", "ative": "",
}
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ism", "ate", "iti", "ous", "ive", "ize", "ion",
)
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDING = "cdeghkmnrt"


def _suffix_pattern(suffixes) -> re.Pattern:
    # The leftmost match of an anchored alternation is the longest suffix.
    return re.compile(f"(?:{'|'.join(suffixes)})$")


_REGION = re.compile(r"[aeiouy][^aeiouy]")
_REGION_PREFIX = re.compile(r"^(?:gener|commun|arsen)")
_SHORT_END = re.compile(r"(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
_VOWEL = re.compile(r"[aeiouy]")
_STEP0 = _suffix_pattern(["'s'", "'s", "'"])
_STEP1B = _suffix_pattern(["eedly", "eed", "ingly", "edly", "ing", "ed"])
_STEP2 = _suffix_pattern(STEP2)
_STEP3 = _suffix_pattern(STEP3)
_STEP4 = _suffix_pattern(STEP4)


def _region(word: str, start: int) -> int:
    found = _REGION.search(word, start)
    return found.end() if found else len(word)


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")):
        return word
    if word.endswith("s") and _VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past_or_gerund(word: str, r1: int) -> str:
    found = _STEP1B.search(word)
    if not found:
        return word
    start = found.start()
    if found.group().startswith("eed"):
        return word[:start] + "ee" if start >= r1 else word
    if not _VOWEL.search(word[:start]):
        return word
    word = word[:start]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if word.endswith(DOUBLES):
        return word[:-1]
    if r1 >= len(word) and _SHORT_END.search(word):
        return word + "e"
    return word


def _replace_suffix(word: str, r1: int, r2: int) -> str:
    found = _STEP2.search(word)
    if found and found.start() >= r1:
        suffix, head = found.group(), word[: found.start()]
        allowed = {"ogi": head.endswith("l"), "li": head.endswith(tuple(LI_ENDING))}
        if allowed.get(suffix, True):
            word = head + STEP2[suffix]
    found = _STEP3.search(word)
    if found and found.start() >= (r2 if found.group() == "ative" else r1):
        word = word[: found.start()] + STEP3[found.group()]
    found = _STEP4.search(word)
    if found and found.start() >= r2:
        head = word[: found.start()]
        if found.group() != "ion" or head.endswith(("s", "t")):
            word = head
    return word


def _final_letter(word: str, r1: int, r2: int) -> str:
    last = len(word) - 1
    if word.endswith("e"):
        if last >= r2 or (last >= r1 and not _SHORT_END.search(word[:-1])):
            return word[:-1]
    elif word.endswith("ll") and last >= r2:
        return word[:-1]
    return word


def stem(word: str | None) -> str | None:
    if word is None:
        return None
    word = word.lower().replace("’", "'")
    if len(word) <= 2:
        return word
    if word in SPECIAL:
        return SPECIAL[word]
    word = word.removeprefix("'")
    word = re.sub(r"^y|(?<=[aeiouy])y", "Y", word)
    prefix = _REGION_PREFIX.match(word)
    r1 = prefix.end() if prefix else _region(word, 0)
    r2 = _region(word, r1)
    word = _plural(_STEP0.sub("", word))
    if word in KEEP_AFTER_PLURAL:
        return word
    word = _past_or_gerund(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not _VOWEL.match(word[-2]):
        word = word[:-1] + "i"
    word = _final_letter(_replace_suffix(word, r1, r2), r1, r2)
    return word.replace("Y", "y")
