"""Token estimate as native column expressions and as plain Python.

The estimate of a text is 0 for the empty text, else the larger of a quarter of its
code points (rounded up) and its words separated by Unicode white space, at least 1.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points with the Unicode property White_Space, as a Python regex class body (fixed values); Java knows them by name, many times faster than as a class.
WHITE_SPACE_PY = "\t-\r \x85\xa0  -     　"
_WORDS = re.compile(f"[^{WHITE_SPACE_PY}]+")


def word_count(text: Column | str) -> Column:
    """Words separated by Unicode white space; null for null."""
    return F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"\P{IsWhite_Space}++")).cast("long")


def estimate(text: Column | str) -> Column:
    """Token estimate of a string column, evaluated in the JVM; null for null."""
    c = F.col(text) if isinstance(text, str) else text
    n = F.length(c)
    return F.when(c.isNull(), F.lit(None)).when(n == 0, F.lit(0)).otherwise(F.greatest(F.ceil(n / 4), word_count(c), F.lit(1))).cast("long")


def estimate_py(text: str | None) -> int | None:
    """The same for one Python string."""
    if text is None:
        return None
    return 0 if not text else max(-(-len(text) // 4), len(_WORDS.findall(text)), 1)
