"""Diacritic folding and tokens as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def folding() -> tuple[str, str]:
    """Lower-case letters with marks and their base letters, by canonical decomposition."""
    pairs = []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        c = chr(code)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c and c == c.lower():
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column | str) -> Column:
    """Lower case without diacritics; combining marks go."""
    column = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.translate(F.lower(column), *folding()), r"\p{M}+", "")


def tokens(text: Column | str) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens_of(text: str) -> list[str]:
    """The same of a Python string, for queries."""
    import re

    folded = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", folded)
