"""String expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One token for each Han character, else for each word, with the white space after it; joined, they give the text.
TOKEN = r"\p{IsHan}\s*|[^\s\p{IsHan}]+\s*|^\s+"
#: A token without its white space.
WORD = r"\p{IsHan}|[^\s\p{IsHan}]+"


def tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column | str) -> Column:
    """Distinct lower-case tokens without their white space."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def first_sentence(text: Column | str, most: int = 80) -> Column:
    """The first sentence, clipped; the default in place of a model."""
    return F.substring(F.regexp_extract(text, "^[^.!?。！？\n]*[.!?。！？]?", 0), 1, most)
