"""Text functions on columns. All are built-in expressions, but for those that end in ``_udf`` and the compatibility forms of texts that are not ASCII."""

from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from tessera.session import ship

# Names of months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


#: All white space, as a list of characters, which needs no regular expression.
SPACE = "".join(chr(c) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(c, F.lit(SPACE))


def category_slug(c: Column) -> Column:
    return F.replace(F.upper(strip(c)), F.lit(" "), F.lit("_"))


#: The single characters that end a line, besides the line feed.
LINE_ENDS = "\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"


def split_lines(c: Column, ends: str = LINE_ENDS) -> Column:
    """The lines of a text, with empty ones. Line ends become line feeds first, as a text is cut at one character without a regular expression."""
    return F.split(F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), ends, "\n" * len(ends)), "\n")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalised_for_copies(c: Column) -> Column:
    """Lower case, marks as blanks, numbers as ``<num>``, names of months as ``<month>``."""
    text = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    text = F.regexp_replace(text, r"(?<![\p{L}\p{N}_])\d+(?![\p{L}\p{N}_])", "<num>")
    text = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(MONTHS)})(?![\p{{L}}\p{{N}}_])", "<month>")
    return collapse(text)


def plain_form(c: Column) -> Column:
    """Lower case, marks as blanks. For texts that are in their compatibility form."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_\s]", " "))


def _forms(texts: pa.Array) -> pa.Array:
    """The compatibility form of each different text. Arrow's own kernel leaves letters and their accents apart, so it is not the same."""
    different = texts.dictionary_encode()
    return pa.array([unicodedata.normalize("NFKC", x) for x in different.dictionary.to_pylist()], pa.string()).take(different.indices)


@F.arrow_udf(StringType())
def nfkc_udf(text: pa.Array) -> pa.Array:
    return _forms(text)


@F.arrow_udf(ArrayType(StringType()))
def nfkc_items_udf(items: pa.Array) -> pa.Array:
    flat = _forms(items.flatten())
    sizes = np.cumsum(np.concatenate([[0], pc.fill_null(pc.list_value_length(items), 0).to_numpy(zero_copy_only=False)])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), flat, mask=items.is_null())


#: What is not ASCII. Only such texts are looked at in Python.
_OTHER = r"[^\p{ASCII}]"


def nfkc(c: Column) -> Column:
    """The compatibility form. Texts of ASCII are that already, and are not looked at."""
    ship(SparkSession.active())  # the executors' Python imports this module
    return F.when(c.rlike(_OTHER), nfkc_udf(F.when(c.rlike(_OTHER), c))).otherwise(c)


def nfkc_items(c: Column) -> Column:
    """The compatibility forms of the texts of a list, in one call."""
    ship(SparkSession.active())
    other = F.exists(c, lambda x: x.rlike(_OTHER))
    return F.when(other, nfkc_items_udf(F.when(other, c))).otherwise(c)


def normalised(c: Column) -> Column:
    """Compatibility form, lower case, marks as blanks. Not for use within functions on the items of a list, which take no Arrow function: see ``normalised_items``."""
    return plain_form(nfkc(c))


def normalised_items(c: Column) -> Column:
    """The texts of a list, each normalised."""
    return F.transform(nfkc_items(c), plain_form)


def signature(*parts: Column) -> Column:
    """What tells a record from others for near copies: its parts, null ones left out, as one normalised text. A list is its items in a row."""
    return normalised_for_copies(F.concat_ws(" ", *parts))


@F.arrow_udf(DoubleType())
def similarity_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """The ratio of matching blocks, which depends on the order: a is the earlier text."""
    found = []
    for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
        matcher = difflib.SequenceMatcher(None, x or "", y or "")
        found.append(matcher.ratio())
    return pa.array(found, pa.float64())


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), 0)


def ngrams(words: Column, n: int) -> Column:
    """Each ``n`` words in a row, joined. ``words`` is computed once, not for each of them."""
    each = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return words if n == 1 else F.get(F.transform(F.array(words), each), 0)


def lines(c: Column) -> Column:
    """Lines with something in them, stripped."""
    return F.filter(F.transform(split_lines(F.coalesce(c, F.lit("")), "\r"), strip), lambda x: x != "")


def numbered(c: Column) -> Column:
    """(number, text) of the lines ``1. text`` and ``2. text``."""
    found = F.filter(lines(c), lambda x: x.rlike(r"^[12]\.\s+\S"))
    return F.transform(found, lambda x: F.struct(F.substring(x, 1, 1).cast("int").alias("number"), strip(F.substring(x, 3, 1 << 30)).alias("text")))


def valid_format(c: Column) -> Column:
    n = numbered(c)
    return F.coalesce((F.size(n) >= 2) & (F.get(n, 0)["number"] == 1) & (F.get(n, 1)["number"] == 2), F.lit(False))


def exactly_two(c: Column) -> Column:
    return valid_format(c) & (F.size(lines(c)) == 2) & (F.size(numbered(c)) == 2)


def distinct_alternatives(c: Column) -> Column:
    n = numbered(c)
    return F.coalesce(F.lower(F.get(n, 0)["text"]) != F.lower(F.get(n, 1)["text"]), F.lit(False))


def repetition(c: Column) -> Column:
    """Four lines or more, of which one makes up three fifths."""
    return bound(lines(c), repeats)


def repeats(own: Column) -> Column:
    """Whether one makes up three fifths of four lines or more. ``own`` is named more than once, so it should be a column or bound. A line that makes up half is in the middle when they are sorted,
    so only that one is counted."""
    middle = F.get(F.sort_array(own), F.floor(F.size(own) / 2).cast("int"))
    return F.coalesce((F.size(own) >= 4) & ((F.size(own) - F.size(F.array_remove(own, middle))) / F.size(own) >= 0.6), F.lit(False))


def suggestions(c: Column) -> Column:
    """The last ``1.`` and the last ``2.`` line, both or those there are. No blank is needed after the point."""
    found = F.filter(lines(c), lambda x: x.rlike(r"^[12]\.\s*\S"))
    last = lambda k: F.try_element_at(F.transform(F.filter(found, lambda x: F.startswith(x, F.lit(k))), lambda x: strip(F.substring(x, 3, 1 << 30))), F.lit(-1))
    return F.array_compact(F.array(last("1"), last("2")))


def after_marker(c: Column, marker: str = "Output:\n") -> Column:
    at = F.locate(marker, c)
    return F.when(at > 0, F.substr(c, at + len(marker))).otherwise(c)


def slug(c: Column) -> Column:
    """Lower-case letters and digits with ``_`` between them, of the compatibility form."""
    return F.regexp_replace(F.regexp_replace(F.lower(nfkc(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def prediction_filename(model: Column, test_set: Column) -> Column:
    return F.concat(slug(model), F.lit("__"), slug(test_set), F.lit(".jsonl"))


def truncated(c: Column, most: int = 12_000, mark: str = "\n[truncated]") -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def prompt_boundary(c: Column) -> Column:
    """One blank line after the prompt, whatever line ends it had. Fails, when it runs, if that leaves three line breaks or more at the end."""
    out = F.concat(F.regexp_replace(c, r"[\r\n]+\z", ""), F.lit("\n\n"))
    return F.when(out.rlike(r"\n{3,}\z"), F.raise_error(F.lit("a prompt ends with more than one blank line")).cast("string")).otherwise(out)


def exact_ci(a: Column, b: Column) -> Column:
    return F.lower(strip(a)) == F.lower(strip(b))


def pair_assignment(m00: Column, m01: Column, m10: Column, m11: Column) -> Column:
    """The better of the two ways to pair two with two, per pair."""
    return F.greatest(m00 + m11, m01 + m10) / 2


def contains_normalised(text: Column, part: Column) -> Column:
    whole, own = normalised(text), normalised(part)
    return (own != "") & F.contains(whole, own)


def jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0))


def reworded(a: Column, b: Column, words: float = 0.94, ratio: float = 0.95) -> Column:
    """Whether two texts have nearly the same words and letters: the share of common words and the similarity of the texts both reach their bounds."""
    return F.when(jaccard(a, b) >= words, similarity_udf(a, b) >= ratio).otherwise(F.lit(False))
