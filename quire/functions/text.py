"""Text and scalar functions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"(?<![\w.])[+\-−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?"


def normalized(c: Column) -> Column:
    """Comparison key of plain text, natively: white space collapsed, lower case with ß as ss. Equal to folded() for
    composed text of Latin letters."""
    return F.replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), F.lit("ß"), F.lit("ss"))


@F.pandas_udf(T.StringType())
def folded(s: pd.Series) -> pd.Series:
    """Comparison key of any text: NFKC, white space collapsed, case folded."""
    return s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).split()).casefold())


def numbers(c: Column) -> Column:
    """Signed, grouped, decimal and percent numbers of a text, the minus sign as a hyphen and without commas."""
    found = F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda x: F.replace(F.replace(x, F.lit("−"), F.lit("-")), F.lit(","), F.lit("")))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda x: x != "")


def error_rate(distance: Column, reference: Column, candidate: Column) -> Column:
    """Edits over the reference's length; without one, 0 for an empty candidate and 1 for another."""
    return F.when(reference > 0, distance / reference).when(candidate > 0, 1.0).otherwise(0.0)


def accuracy(distance: Column, reference: Column, candidate: Column) -> Column:
    """1 less the edits over the longer of the two; null without a distance."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / F.greatest(reference, candidate, F.lit(1))))
    return F.when(distance.isNotNull(), share)


def edits(a, b) -> int:
    """Edit distance of two sequences. A column of the table is two bit sets, of where it goes up and where it goes down, so a
    step over one item of ``b`` is a handful of operations on whole numbers."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    full, last, total = (1 << len(b)) - 1, 1 << (len(b) - 1), len(b)
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    up, down = full, 0
    for x in a:
        same = places.get(x, 0)
        held = same | down
        flat = ((same & up) + up) ^ up | held
        rises, falls = down | ~(flat | up) & full, up & flat
        total += bool(rises & last) - bool(falls & last)
        rises, falls = (rises << 1 | 1) & full, falls << 1 & full
        up, down = falls | ~(held | rises) & full, rises & held
    return total


@F.pandas_udf(T.LongType())
def sequence_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Edit distance of two arrays of strings; null if either is null."""
    return pd.Series([None if a is None or b is None else edits(list(a), list(b)) for a, b in zip(left, right, strict=True)], dtype="Int64")


def coerced_confidence(c: Column) -> Column:
    """A share of one: percentages are divided by 100, the rest is held within 0 and 1, and what is no finite number is
    null."""
    v = c.try_cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    v = F.when((v > 1) & (v <= 100), v / 100).otherwise(v)
    return F.when(v < 0, 0.0).when(v > 1, 1.0).otherwise(v)


#: What a layout label must contain to be of an element type, in the order of the test.
TYPE_RULES = [
    ("page_number", "page_number"),
    ("list_item", "list_item"),
    ("footnote", "footnote"),
    ("formula", "formula"),
    ("equation", "formula"),
    ("caption", "caption"),
    ("header", "header"),
    ("footer", "footer"),
    ("title", "title"),
    ("heading", "heading"),
    ("section", "heading"),
    ("paragraph", "paragraph"),
    ("table", "table"),
    ("chart", "chart"),
    ("figure", "figure"),
    ("image", "image"),
    ("picture", "image"),
    ("stamp", "stamp"),
    ("signature", "signature"),
    ("checkbox", "checkbox"),
    ("list", "list_item"),
    ("text", "text"),
]


def element_type(label: Column, default: str = "text") -> Column:
    """The type of the first rule whose text a label contains (in lower case, hyphens and spaces as underscores)."""
    v = F.translate(F.lower(F.trim(label)), "- ", "__")
    out = F.lit(default)
    for part, kind in reversed(TYPE_RULES):
        out = F.when(F.contains(v, F.lit(part)), F.lit(kind)).otherwise(out)
    return out


def slug(c: Column, default: str = "item") -> Column:
    """Letters, digits, dots, hyphens and underscores; other runs become one hyphen, and the ends are trimmed."""
    v = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^[-.]+|[-.]+$", "")
    return F.when(F.length(v) > 0, v).otherwise(F.lit(default))


def xml_safe(c: Column) -> Column:
    """Without the characters that XML forbids."""
    return F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


def redacted(c: Column) -> Column:
    """Secrets' values and directories of paths masked."""
    v = F.regexp_replace(c, r"(?i)\b(password|passwd|secret|token|api[_-]?key|authorization)(\s*[=:]\s*)\S+", "$1$2[redacted]")
    return F.regexp_replace(v, r"(?:[A-Za-z]:)?(?:[/\\][\w.-]+)+[/\\]([\w.-]+)", "$1")


def line_kind(line: Column) -> Column:
    """Markdown block kind of one line: blank, fence, heading, rule, list_item, quote, table_row, image or paragraph."""
    t = F.trim(line)
    return (
        F.when(t == "", "blank").when(t.rlike(r"^(```|~~~)"), "fence").when(t.rlike(r"^#{1,6}\s+\S"), "heading").when(t.rlike(r"^([-*_])(\s*\1){2,}$"), "rule")
        .when(t.rlike(r"^([-*+]|\d{1,9}[.)])\s+\S"), "list_item").when(t.startswith(">"), "quote").when(t.rlike(r"^\|.*\|$"), "table_row").when(t.rlike(r"^!\[[^\]]*\]\([^)]*\)$"), "image").otherwise("paragraph")
    )


def math_count(c: Column) -> Column:
    """Inline formulas between single dollars: the opening one stands before no space, the closing one after no space
    and before no digit."""
    return F.regexp_count(c, F.lit(r"(?<![\\$])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?![\d$])"))


def visible_html(c: Column) -> Column:
    """Text of a page without scripts and styles: a new line at block tags, other tags dropped, entities of the five
    marks resolved, lines trimmed and blank ones dropped."""
    v = F.regexp_replace(c, r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->", "")
    v = F.regexp_replace(v, r"(?i)</?(p|div|section|h[1-6]|tr|br)\b[^>]*>", "\n")
    v = F.regexp_replace(v, r"<[^>]*>", "")
    for mark, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        v = F.replace(v, F.lit(mark), F.lit(char))
    lines = F.filter(F.transform(F.split(v, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def token(c: Column) -> Column:
    """A name in lower case without leading dots, hyphens as underscores."""
    return F.translate(F.regexp_replace(F.lower(F.trim(c)), r"^[.]+", ""), "-", "_")


def input_format(c: Column) -> Column:
    """A format's token; short names of files count under the long ones."""
    v = token(c)
    return F.when(v == "jpg", "jpeg").when(v == "tif", "tiff").otherwise(v)


def without_roots(c: Column, roots: list[str]) -> Column:
    """Paths below the given folders reduced to their last name, with either kind of separator."""
    for root in sorted(roots, key=len, reverse=True):
        c = F.regexp_replace(c, re.escape(root) + r"""(?:(?:\\{1,2}|/)[^\s'"`,;:)\]}/\\]+)*(?:\\{1,2}|/)([^\s'"`,;:)\]}/\\]+)""", "$1")
    return c


# Characters that structure a formula or are invisible, and signs that stand for one another.
STRUCTURAL = set("()[]{}|‖⟨⟩⌊⌋⌈⌉∑∏∫∮⋀⋁⋂⋃⨀⨁⨂√―¯‾\u0304\u0305")
INVISIBLE = set("\u2061\u2062\u2063\u2064\u200b\ufeff")
GLYPHS = str.maketrans({"−": "-", "⋅": "·", "′": "'", "″": "''", "⁄": "/", "∕": "/", "∖": "\\"})


def comparable(text: str) -> str:
    """The visible characters of a formula in order of their code points, without structure and space."""
    folded = unicodedata.normalize("NFKC", text).translate(GLYPHS)
    return "".join(sorted(c for c in folded if not c.isspace() and c not in STRUCTURAL and c not in INVISIBLE))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("status", "left_only", "right_only")]))
def character_check(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Whether two visible readings have the same characters, and which only one of them has; a missing reading leaves it
    unanswered."""
    out = []
    for a, b in zip(left, right, strict=True):
        if a is None or b is None:
            out.append(("unanswered", None, None))
            continue
        x, y = Counter(comparable(a)), Counter(comparable(b))
        out.append(("agree" if x == y else "disagree", "".join(sorted((x - y).elements())), "".join(sorted((y - x).elements()))))
    return pd.DataFrame(out, columns=["status", "left_only", "right_only"])
