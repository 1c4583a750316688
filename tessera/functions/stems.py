"""Word stems by Porter's algorithm as published in 1980, and by the extended rules of a widely used toolkit, which scorers of summaries take: some words have fixed stems, short words in -ies and -ied
keep their e, y stays after a vowel, and -bli, -fulli and -logi are suffixes."""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.grams import gram_scores
from tessera.session import ship

# The suffixes of steps 2 to 4 of the algorithm.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "sion", "tion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


# Words with a stem of their own, and the suffixes that the extended rules put in the place of -abli or beside the others of step 2.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "inning": "inning", "innings": "inning", "outing": "outing", "outings": "outing", "canning": "canning",
    "cannings": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
MORE_STEP_2 = {"bli": "ble", "fulli": "ful", "logi": "log"}
EXTENDED_STEP_2 = {k: v for k, v in STEP_2.items() if k != "abli"} | MORE_STEP_2


def _shape(word: str) -> str:
    """``v`` for vowels, ``c`` for the rest; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short_end(word: str, extended: bool = False) -> bool:
    return (_shape(word).endswith("cvc") and word[-1] not in "wxy") or (extended and _shape(word) == "vc")


def _swap(word: str, table: dict[str, str]) -> str:
    """The longest suffix of the table gives way if something with a measure stays."""
    end = max((x for x in table if word.endswith(x)), key=len, default=None)
    return word[: -len(end)] + table[end] if end and _measure(word[: -len(end)]) > 0 else word


def _past(word: str, extended: bool) -> str:
    if extended and word.endswith("ied"):
        return word[:-1] if len(word) == 4 else word[:-2]
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        rest = word.removesuffix(end)
        if rest != word and "v" in _shape(rest):
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if len(rest) > 1 and rest[-1] == rest[-2] and _shape(rest)[-1] == "c" and rest[-1] not in "lsz":
                return rest[:-1]
            return rest + "e" if _measure(rest) == 1 and _short_end(rest, extended) else rest
    return word


def _second(word: str) -> str:
    """Step 2 by the extended rules: -alli gives -al, which may end in another suffix; of -logi the l counts as a part of what stays."""
    if word.endswith("alli") and _measure(word[:-4]) > 0:
        return _second(word[:-2])
    end = max((x for x in EXTENDED_STEP_2 if word.endswith(x)), key=len, default=None)
    if end == "logi":
        return word[:-1] if _measure(word[:-3]) > 0 else word
    return _swap(word, EXTENDED_STEP_2)


@lru_cache(1 << 16)
def stem(word: str, extended: bool = False) -> str:
    if extended and word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) < 3:
        return word
    if extended and word.endswith("ies") and len(word) == 4:
        word = word[:-1]
    elif word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _past(word, extended)
    if word.endswith("y") and (len(word) > 2 and _shape(word)[-2] == "c" if extended else "v" in _shape(word[:-1])):
        word = word[:-1] + "i"
    word = _swap(_second(word) if extended else _swap(word, STEP_2), STEP_3)
    end = max((x for x in STEP_4 if word.endswith(x)), key=len, default=None)
    if end:
        rest = word[: -len(end)] + (end[0] if end in ("sion", "tion") else "")
        word = rest if _measure(rest) > 1 else word
    if word.endswith("e"):
        rest = word[:-1]
        word = rest if _measure(rest) > 1 or (_measure(rest) == 1 and not _short_end(rest, extended)) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stems(text: str | None) -> list[str]:
    """Stems of words of letters a to z and digits; words of three characters or less stay."""
    return [stem(x) if len(x) > 3 else x for x in re.findall("[a-z0-9]+", (text or "").lower())]


def overlap(a: list, b: list) -> float:
    """F1 of common items, with multiplicity; 0 if either has none."""
    both = sum((Counter(a) & Counter(b)).values())
    return 2 * both / (len(a) + len(b)) if both else 0.0


@F.arrow_udf(ArrayType(StringType()))
def stems_udf(words: pa.Array) -> pa.Array:
    """Stems, by the extended rules, of lists of words; each different word is looked at once in a batch."""
    different = words.flatten().dictionary_encode()
    found = pa.array([stem(x, True) if len(x) > 3 else x for x in different.dictionary.to_pylist()], pa.string()).take(different.indices)
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), found)


def stemmed_words(text: Column) -> Column:
    """The stems of the words of a text: runs of a-z and digits of its lower-case form; words of three characters or less stay."""
    ship(SparkSession.active())
    return stems_udf(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0))


def stemmed_scores(prediction: Column, reference: Column) -> Column:
    """A struct (rouge1, rouge2) of F1 scores on stems."""
    return gram_scores(stemmed_words(prediction), stemmed_words(reference), [1, 2])
