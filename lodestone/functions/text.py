"""Text expressions: the search tokenizer, byte offsets, and small parsers."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _accents() -> tuple[str, str]:
    """Composed Latin letters and the letters they are built on, by the rule of canonical decomposition."""
    pairs = []
    for point in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(point))
        if len(parts) > 1 and all(0x300 <= ord(c) <= 0x331 for c in parts[1:]):
            pairs.append((chr(point), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def folded(c) -> Column:
    return F.lower(F.translate(_col(c), ACCENTED, PLAIN))


def tokens(c) -> Column:
    """Search tokens: runs of letters and digits, accents stripped, in lower case; none for null."""
    return F.coalesce(F.regexp_extract_all(folded(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def fold_python(text: str) -> str:
    """``folded`` for one string, with full decomposition."""
    parts = unicodedata.normalize("NFD", text)
    return unicodedata.normalize("NFC", "".join(c for c in parts if not 0x300 <= ord(c) <= 0x331)).lower()


def phrase(word: str) -> list[str]:
    """A query word as the phrase of its tokens."""
    import regex

    return regex.findall(TOKEN, fold_python(word))


def byte_slice(c, start, end) -> Column:
    """Bytes [start, end) of a text, as text."""
    raw = _col(c).cast("binary")
    return F.substring(raw, start + F.lit(1), end - start).cast("string")


def phrase_count(token_col, words: list[str]) -> Column:
    """How often the words follow each other in an array of tokens.

    The array is zipped with itself, shifted: a lambda that looked into the array would compute it anew for each element.
    """
    t = _col(token_col)
    if len(words) == 1:
        return F.size(F.filter(t, lambda x: x == words[0]))
    here = F.transform(t, lambda x: x == words[0])
    for k, w in enumerate(words[1:], 1):
        here = _both(here, F.slice(t, F.lit(k + 1), F.size(t)), w)
    return F.size(F.filter(here, lambda x: x))


def _both(here: Column, following: Column, word: str) -> Column:
    return F.zip_with(here, following, lambda so_far, x: so_far & F.coalesce(x == word, F.lit(False)))


UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "KIB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "MIB": 1 << 20, "G": 1 << 30, "GB": 1 << 30, "GIB": 1 << 30}


def parse_size(text: str) -> int:
    """A size like 64MiB in bytes; KB and KiB both count 1024. Zero and larger units are errors."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in UNITS or int(m[1]) == 0:
        raise ValueError(f"invalid size: {text!r}")
    return int(m[1]) * UNITS[m[2].upper()]
