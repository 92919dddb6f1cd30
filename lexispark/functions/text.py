"""Normalisation and tokenisation of text, as Columns and, for query strings, in Python by the same patterns."""

from __future__ import annotations

from functools import lru_cache

import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Wide forms U+3000 and U+FF01 to U+FF5E and their half-width forms.
WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = " " + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
#: What a normalised text keeps, and the runs that are cut from it.
DROPPED = r"[^\p{L}\p{Nd}\-.\p{Z}]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"
RUN = r"(?:\p{Nd}+|[a-z]+|[^ \-.a-z\p{Nd}]+)"
TOKEN = rf"[\-.]+(?:{RUN}(?:[\-.]+{RUN})*[\-.]*)?|{RUN}(?:[\-.]+{RUN})*[\-.]*"
PLAIN = r"^[a-z\p{Nd}]"
#: Longest run without Latin letters and digits that is segmented; the rest of it is cut off.
LONGEST_RUN = 20

_DROPPED_PY, _TOKEN_PY, _PLAIN_PY = (regex.compile(p) for p in (DROPPED, TOKEN, PLAIN))
_WIDE_PY = str.maketrans(WIDE, HALF)


def half_width(c: Column) -> Column:
    """Wide forms to half-width ones; null to ''."""
    return F.translate(F.coalesce(c, F.lit("")), WIDE, HALF)


def replace_characters(c: Column, table: dict[str, str]) -> Column:
    """Each character by another one, such as traditional by simplified ones."""
    return F.translate(c, "".join(table), "".join(table.values())) if table else c


@lru_cache(2)
def simplified_characters() -> dict[str, str]:
    """Traditional -> simplified Han characters by the rules of Spark's own ICU library; an error without it."""
    session = SparkSession.active()
    rules = session._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    han = "".join(map(chr, range(0x4E00, 0xA000)))
    to = rules.transliterate(" ".join(han)).split(" ")
    if len(to) != len(han):
        raise RuntimeError("the ICU library does not map characters one by one")
    return {a: b for a, b in zip(han, to) if a != b and len(b) == 1}


def drop_symbols(c: Column) -> Column:
    """Everything but letters, decimal digits, '-', '.' and separators to a blank; a character beyond U+FFFF to two."""
    return F.regexp_replace(F.regexp_replace(c, ASTRAL, "  "), DROPPED, " ")


def normalize(c: Column, variants: dict[str, str] | None = None, punctuation: str = "") -> Column:
    """Half width, simplified characters, lower case, no symbols, no listed punctuation, in this order. Null gives ''."""
    c = drop_symbols(F.lower(replace_characters(half_width(c), variants or {})))
    return F.translate(c, punctuation, " " * len(punctuation)) if punctuation else c


def tokens(normalized: Column) -> Column:
    """Runs between blanks, cut where Latin letters, digits and other characters meet, never beside '-' or '.'."""
    return F.regexp_extract_all(normalized, F.lit(f"({TOKEN})"), F.lit(1))


def tokens_with_gaps(normalized: Column) -> Column:
    """Tokens and single blanks in order, so that lengths add up to positions."""
    return F.regexp_extract_all(normalized, F.lit(f"({TOKEN}| )"), F.lit(1))


def is_plain(token: Column) -> Column:
    """Whether a token is a term as it stands (Latin or digits); any other is a run to be segmented."""
    return token.rlike(PLAIN)


def bucket(token: Column) -> Column:
    """'digits', 'latin' or 'run' by the first character of a token."""
    return F.when(token.rlike(r"^\p{Nd}"), "digits").when(token.rlike("^[a-z]"), "latin").otherwise("run")


def single_characters(token: Column, longest: int | None = LONGEST_RUN) -> Column:
    """Segmentation without a dictionary: each of the first ``longest`` characters, or of all."""
    return F.split(F.substring(token, 1, longest) if longest else token, "")


def value_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(c) + F.length(F.regexp_replace(c, r"[^\x{10000}-\x{10FFFF}]", ""))


def normalize_python(text: str | None, variants: dict[str, str] | None = None, punctuation: str = "") -> str:
    """``normalize`` for one string."""
    text = (text or "").translate(_WIDE_PY)
    if variants:
        text = text.translate(str.maketrans(variants))
    text = regex.sub(r"[\U00010000-\U0010FFFF]", "  ", text.lower())
    text = _DROPPED_PY.sub(" ", text)
    return text.translate(str.maketrans(dict.fromkeys(punctuation, " "))) if punctuation else text


def tokens_python(normalized: str) -> list[tuple[str, int]]:
    """(token, position) of a normalised string."""
    return [(m.group(), m.start()) for m in _TOKEN_PY.finditer(normalized)]


def is_plain_python(token: str) -> bool:
    return bool(_PLAIN_PY.match(token))
