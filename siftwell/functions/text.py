"""Text functions for Python workers: cleaning, words, tokens. Column versions are in columns.py."""

from __future__ import annotations

import html
import re

# Windows-1252 characters of the C1 range; the five bytes without one vanish.
C1 = {i: bytes([i]).decode("cp1252", "ignore") for i in range(0x80, 0xA0)}
_C1_SEEN = re.compile("[\x80-\x9f]")
_MARKS = {0xA0: " ", 0xFEFF: None, 0x200B: None}
_MARKS_SEEN = re.compile("[\u00a0\ufeff\u200b]")
WORD = re.compile(r"[^\W_]+")
TOKEN = re.compile(r"\w+|[^\w\s]+")
_BLANKS = re.compile(r"[ \t\r\f\v]+")


def unescape(text: str, rounds: int = 4) -> str:
    """HTML entities resolved until nothing changes, at most `rounds` times."""
    for _ in range(rounds):
        if "&" not in text:
            break
        resolved = html.unescape(text)
        if resolved == text:
            break
        text = resolved
    return text


def repair(text: str | None) -> str:
    """Cleaned text: entities, C1 leftovers, hard spaces and invisible marks. Null counts as empty."""
    if not text:
        return ""
    text = unescape(text)
    if _C1_SEEN.search(text):
        text = text.translate(C1)
    if _MARKS_SEEN.search(text):
        text = text.translate(_MARKS)
    return text


def clean(text: str | None) -> str:
    """repair(), with blanks collapsed and stripped per line and around the whole."""
    lines = repair(text).split("\n")
    return "\n".join(_BLANKS.sub(" ", line).strip() for line in lines).strip()


def words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits in the cleaned text."""
    return WORD.findall(repair(text).lower())


def tokens(text: str | None) -> list[str]:
    """Words and punctuation runs of the text as stored."""
    return TOKEN.findall(text or "")


def count_tokens(text: str | None) -> int:
    return sum(1 for _ in TOKEN.finditer(text or ""))
