"""Porter's stemmer (Porter, 1980), written from the published rules."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

_VOWEL_THEN = re.compile(r"[aeiouy]")

# Published suffix rules: (suffix, replacement), longest match within each step.
_STEP2 = dict(ational="ate", tional="tion", enci="ence", anci="ance", izer="ize", abli="able", alli="al", entli="ent", eli="e", ousli="ous", ization="ize", ation="ate", ator="ate", alism="al", iveness="ive", fulness="ful", ousness="ous", aliti="al", iviti="ive", biliti="ble")
_STEP3 = dict(icate="ic", ative="", alize="al", iciti="ic", ical="ic", ful="", ness="")
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    out = ""
    for k, c in enumerate(word):
        out += "v" if c in "aeiou" or (c == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return len(word) > 2 and _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, rules: dict[str, str]) -> str:
    for suffix in sorted(rules, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + rules[suffix] if _measure(base) > 0 else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    word = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            word = word[: len(word) - len(suffix)] + new
            break
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        for suffix in ("ed", "ing"):
            if word.endswith(suffix) and _has_vowel(word[: -len(suffix)]):
                word = word[: -len(suffix)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif _double(word) and word[-1] not in "lsz":
                    word = word[:-1]
                elif _measure(word) == 1 and _cvc(word):
                    word += "e"
                break
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, _STEP2), _STEP3)
    for suffix in sorted(_STEP4, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _cvc(base)):
            word = base
    if _measure(word) > 1 and _double(word) and word.endswith("l"):
        word = word[:-1]
    return word
