"""The two alternatives of a generated reply: by built-in expressions, or, where markers must be weighed by their places, by an Arrow function."""

from __future__ import annotations

import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tessera.functions.text import bound, normalised_items, plain_form, split_lines, strip

# Headers and field labels that are no alternative, list marks, and what starts a commentary.
HEADERS = ["alternatives", "alternative descriptions", "bank transfer descriptions", "output", "response"]
MORE_HEADERS = ["descriptions", "normalized descriptions"]
LABELS = [
    "category", "beneficiary", "amount", r"transfer\s+amount", r"reference(?:\s+period)?", r"calendar\s+context", "event", "date", r"event\s+category", r"partial\s+description",
    "deposit", "mode", "destination", "reason", r"invoice\s+number", "service", "departure", "context", "purpose", "method", "time", "cost", "pickup", "recipient", "transfer",
]
COMMENTARY = r"explanation|reasoning|notes?|both\s+(?:descriptions|alternatives)"
STRICT_NAMES = r"(?:alternative|option|normalized\s+description|description)"
LOOSE_NAMES = "(?:alternative|option)"
BULLET = r"^\s*[-*•]\s*"
MARK = r"\s*[.):\-]\s*"


def _as_header() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatibility form is one ASCII character, and those whose form is several that stand in a header, with their forms."""
    forms = {c: unicodedata.normalize("NFKC", c).lower() for c in map(chr, range(0x80, 0x20000)) if unicodedata.decomposition(c)}
    plain = {c: form for c, form in forms.items() if form.isascii()}
    return {c: x for c, x in plain.items() if len(x) == 1}, {c: x for c, x in plain.items() if len(x) > 1 and any(x in h for h in HEADERS + MORE_HEADERS)}


_ONE, _SEVERAL = _as_header()


def is_header(line: Column, headers: list[str]) -> Column:
    """Whether a line is a header when it is normalised. Headers are ASCII, so only characters whose compatibility forms are ASCII need to be replaced, which built-in functions do."""
    out = F.translate(line, "".join(_ONE), "".join(_ONE.values()))
    for c, form in _SEVERAL.items():
        out = F.replace(out, F.lit(c), F.lit(form))
    return plain_form(F.when(line.rlike(r"[^\p{ASCII}]"), out).otherwise(line)).isin(headers)


def without_commentary(c: Column) -> Column:
    """The text before the first line that starts a commentary."""
    return strip(F.regexp_replace(strip(c), rf"(?imsdU)^\s*(?:{COMMENTARY})\b.*", ""))


def _without_marks(c: Column, marks: list[str]) -> Column:
    out = strip(c)
    for mark in marks:
        out = F.regexp_replace(out, f"(?iU){mark}", "")
    return strip(out)


def strict_item(c: Column) -> Column:
    """Without list marks, each kind once; a number is a mark only before a blank or the end. Commentary goes."""
    marks = [BULLET, r"^\s*\d+\s*[.):\-](?:[ \t]+|\z)", rf"^\s*{LOOSE_NAMES}\s*\d+{MARK}", rf"^\s*(?:normalized\s+description|description)\s*\d+{MARK}"]
    return without_commentary(_without_marks(c, marks))


def loose_item(c: Column) -> Column:
    """Without list marks, each kind once; any number with a mark is one."""
    return _without_marks(c, [BULLET, rf"^\s*\d+{MARK}", rf"^\s*alternative\s*\d+{MARK}", rf"^\s*option\s*\d+{MARK}"])


def _some(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def _json_items(text: Column) -> Column:
    """The items of a JSON list as strings, blank ones left out; null for anything else."""
    listed = text.startswith("[") & text.endswith("]") & F.try_parse_json(text).isNotNull()
    return F.when(listed, F.filter(F.from_json(text, "array<string>"), lambda x: F.coalesce(strip(x), F.lit("")) != ""))


def _groups(text: Column, pattern: str) -> Column:
    """The two groups of the first match; null without one."""
    return F.when(text.rlike(pattern), F.array(F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)))


def alternatives(c: Column) -> Column:
    """Two alternatives at most. A JSON list, else a named pair, else a numbered pair (marks at the start of lines), else two plain lines, else the
    parts of a line between bars, else the only line; three plain lines or more give nothing, as does null."""

    def pair(name: str, stop: str) -> str:
        return rf"(?imsdU)^\s*{name}\s*1{MARK}(.*?)^\s*{name}\s*2{MARK}(.*?)(?=^\s*(?:{stop})\b|\z)"

    def plain(text: Column) -> Column:
        fields = rf"(?iU)^\s*(?:{'|'.join(LABELS)})\s*:"
        kept = F.filter(F.transform(split_lines(text), strict_item), lambda x: (x != "") & ~is_header(x, HEADERS + MORE_HEADERS) & ~x.rlike(fields))
        parts = lambda line: bound(_some(F.transform(F.split(line, r"[ \t]*\|[ \t]*"), strict_item)), lambda p: F.when(F.size(p) >= 2, F.slice(p, 1, 2)).otherwise(F.array(line)))
        return bound(kept, lambda k: F.when(F.size(k) == 2, k).when(F.size(k) == 1, parts(F.get(k, 0))).otherwise(F.array().cast("array<string>")))

    def whole(text: Column) -> Column:
        clean = lambda items: F.slice(_some(F.transform(items, strict_item)), 1, 2)
        return F.coalesce(clean(_json_items(text)), clean(_groups(text, pair(STRICT_NAMES, COMMENTARY))), clean(_groups(text, pair("", rf"3\s*[.):\-]|{COMMENTARY}"))), plain(text))

    return bound(strip(F.coalesce(c, F.lit(""))), whole)


def alternatives_loose(c: Column) -> Column:
    """As ``alternatives`` by older rules: marks count anywhere, commentary stays, and of two plain lines or more the first two are taken."""

    def plain(text: Column) -> Column:
        kept = F.filter(F.transform(split_lines(text), loose_item), lambda x: (x != "") & ~is_header(x, HEADERS))
        some = lambda line: F.filter(F.split(line, r"(?U)\s*\|\s*"), lambda x: strip(x) != "")
        parts = lambda line: bound(F.transform(some(line), loose_item), lambda p: F.when(F.size(p) >= 2, F.slice(p, 1, 2)).otherwise(F.array(line)))
        return bound(kept, lambda k: F.when(F.size(k) >= 2, F.slice(k, 1, 2)).when(F.size(k) == 1, parts(F.get(k, 0))).otherwise(F.array().cast("array<string>")))

    def whole(text: Column) -> Column:
        named = rf"(?isdU){LOOSE_NAMES}\s*1{MARK}(.+?)\s+{LOOSE_NAMES}\s*2{MARK}(.+)\z"
        numbered = rf"(?isdU)^\s*1{MARK}(.+?)\s+2{MARK}(.+)\z"
        clean = lambda items: F.slice(F.transform(items, loose_item), 1, 2)
        return F.coalesce(clean(_json_items(text)), clean(_groups(text, named)), clean(_groups(text, numbered)), plain(text))

    return bound(strip(F.coalesce(c, F.lit(""))), whole)


def two_distinct(items: Column) -> Column:
    """Two alternatives, neither empty, that differ when normalised."""
    same = lambda n: (F.size(n) == 2) & (F.get(n, 0) != "") & (F.get(n, 1) != "") & (F.get(n, 0) != F.get(n, 1))
    return F.coalesce(bound(normalised_items(items), same), F.lit(False))


def exact_pair(items: Column, references: Column) -> Column:
    """The share of two references met by alternatives of the same normalised text, in the better order."""
    same = lambda n, i, j: F.coalesce((F.get(n["a"], i) == F.get(n["b"], j)) & (F.get(n["a"], i) != ""), F.lit(False)).cast("double")
    both = F.struct(normalised_items(items).alias("a"), normalised_items(references).alias("b"))
    return bound(both, lambda n: F.greatest(same(n, 0, 0) + same(n, 1, 1), same(n, 0, 1) + same(n, 1, 0)) / 2)


# How a line of Markdown may begin, and the names of alternatives there.
LINE_START = r"^[ \t]*(?:>[ \t]*)?(?:#{1,6}[ \t]*)?(?:[-+*][ \t]+)?(?:\*\*|__)?[ \t]*"
MARKDOWN_NAMES = r"(?:alternative|option|normalized[ \t]+description|description|bank[- \t]+transfer[ \t]+description)"
CLOSE = r"[ \t]*(?:(?:\*\*|__)[ \t]*)?[.):\-](?:[ \t]*(?:\*\*|__))?[ \t]*"
MARKERS = {"named": rf"(?im){LINE_START}{MARKDOWN_NAMES}[ \t]*(?P<number>[12])(?:[ \t]*\([^)\r\n]{{1,60}}\))?{CLOSE}", "numbered": rf"(?im){LINE_START}(?P<number>[12]){CLOSE}"}
MARKDOWN_COMMENTARY = rf"(?im){LINE_START}(?:explanation|reasoning|notes?|both[ \t]+(?:descriptions|alternatives)).*$"
MARKDOWN_MARKS = [r"^\s*[-*•]\s+", r"^\s*\d+\s*[.):\-](?:[ \t]+|$)", rf"^\s*{LOOSE_NAMES}\s*\d+{MARK}", rf"^\s*(?:normalized\s+description|description)\s*\d+{MARK}", r"^\s*```(?:text)?[ \t]*(?:\r?\n)?", r"(?:\r?\n)?[ \t]*```\s*$"]


def _plain(text: str) -> str:
    return " ".join(re.sub(r"[^\w\s]", " ", unicodedata.normalize("NFKC", text).lower()).split())


def _markdown_item(text: str) -> str:
    """Without list marks and a fence around it, each once, and without commentary; emphasis stays."""
    text = text.strip()
    for mark in MARKDOWN_MARKS:
        text = re.sub(mark, "", text, flags=re.I)
    return re.split(MARKDOWN_COMMENTARY, text.strip(), maxsplit=1)[0].strip()


def _between_markers(text: str) -> list[str]:
    """What follows the earliest marker 1 whose next marker of its kind is a 2, and what follows that 2, both not empty; without such a pair
    what follows the earliest marker 1. A text ends where any marker or commentary begins, but for the first of a pair, which ends at its 2."""
    hits = {kind: list(re.finditer(pattern, text)) for kind, pattern in MARKERS.items()}
    stops = sorted(x.start() for own in (*hits.values(), re.finditer(MARKDOWN_COMMENTARY, text)) for x in own)
    end = lambda hit: next((s for s in stops if s >= hit.end() and s > hit.start()), len(text))
    pairs, singles = [], []
    for own in hits.values():
        for a, b in zip(own, [*own[1:], None], strict=False):
            if a["number"] != "1":
                continue
            singles.append((a.start(), end(a), [_markdown_item(text[a.end() : end(a)])]))
            if b and b["number"] == "2":
                pairs.append((a.start(), end(b), [_markdown_item(text[a.end() : b.start()]), _markdown_item(text[b.end() : end(b)])]))
    whole = sorted(x for x in pairs if all(x[2])) or sorted(x for x in singles if all(x[2]))
    return whole[0][2] if whole else []


def markdown_alternatives(text: str | None) -> list[str]:
    """As ``alternatives`` for replies with Markdown: markers of two kinds, of which the earliest whole pair counts, even if one breaks off later."""
    text = (text or "").strip()
    if text.startswith("[") and text.endswith("]"):
        try:
            return [x for x in (_markdown_item(str(x)) for x in json.loads(text) if str(x).strip()) if x][:2]
        except json.JSONDecodeError:
            pass
    if found := _between_markers(text):
        return found
    kept = []
    for line in map(_markdown_item, text.splitlines()):
        bare = re.sub(r"^\s*[-+]\s+", "", re.sub(r"[*_`#>]", "", line).strip())
        label = re.match(rf"\s*(?:{'|'.join(LABELS)})\s*:", bare, re.I)
        if line and not re.fullmatch(r"```(?:text)?", line, re.I) and not label and _plain(bare) not in HEADERS + MORE_HEADERS:
            kept.append(line)
    if len(kept) == 1:
        parts = [x for x in map(_markdown_item, re.split(r"[ \t]*\|[ \t]*", kept[0])) if x]
        return parts[:2] if len(parts) > 1 else kept
    return kept if len(kept) == 2 else []


@F.arrow_udf(ArrayType(StringType()))
def markdown_alternatives_udf(text: pa.Array) -> pa.Array:
    return pa.array([markdown_alternatives(x) for x in text.to_pylist()], pa.list_(pa.string()))
