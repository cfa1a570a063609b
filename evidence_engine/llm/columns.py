"""Column builders that several operators of this subpackage share."""

from __future__ import annotations

import string

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that the contracts mean: space and U+0009 to U+000D.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """The wanted column names, with as many underscores before them as keep them apart from those taken (case does not tell names apart)."""
    used, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts of ASCII alone take the quick way; lower() would also change É."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
