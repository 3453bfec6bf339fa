"""Text functions as columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftwell.functions.text import C1

# White space as Python's str.strip() sees it, for Java and RE2 patterns.
SPACE = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
WORD_CHARS = r"\p{L}\p{N}_"
TOKEN_PATTERN = rf"[{WORD_CHARS}]+|[^{WORD_CHARS}{SPACE}]+"


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def fold(text: Column) -> Column:
    """Stripped and in lower case; blank becomes null."""
    folded = F.lower(strip(text))
    return F.when(folded != "", folded)


def unescape_basic(text: Column, rounds: int = 4) -> Column:
    """The five commonest named entities and the decimal apostrophe, up to four rounds; see text.unescape for all."""
    for _ in range(rounds):
        for entity, char in (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
            text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def repair_c1(text: Column) -> Column:
    """U+0080 to U+009F as their Windows-1252 characters, or nothing."""
    known = {chr(k): v for k, v in C1.items() if v}
    lost = "".join(chr(k) for k, v in C1.items() if not v)
    return F.translate(F.translate(text, "".join(known), "".join(known.values())), lost, "")


def plain_marks(text: Column) -> Column:
    """Hard spaces as spaces; byte-order marks and zero-width spaces gone."""
    return F.translate(F.translate(text, "\u00a0", " "), "\ufeff\u200b", "")


def ruler(text: Column) -> Column:
    """Length in runs of non-blank characters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1)))


def token_count(text: Column) -> Column:
    """Number of words and punctuation runs."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))
