"""Column expressions shared by the text operators: repair of width, spaces and invisible marks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import compose

# Letters of Cyrillic and Greek that look like Latin ones, position by position.
LOOKALIKE_FROM = "асеорхукіјѕԁһԛԝүАВЕКМНОРСТУХІЈЅԚԜҮαονρικυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LOOKALIKE_TO = "aceopxykijsdhqwyABEKMHOPCTYXIJSQWYaovpikuxABEZHIKMNOPTYX"

#: Characters that show nothing: soft hyphen, zero-width marks, direction marks, joiners, fillers, selectors.
INVISIBLE = "\\u00AD\\u034F\\u061C\\u115F\\u1160\\u17B4\\u17B5\\u180B-\\u180F\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u206F\\u3164\\uFE00-\\uFE0F\\uFEFF\\uFFA0"
#: Spaces other than U+0020.
ODD_SPACE = "\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def skeleton(c: Column) -> Column:
    """A comparison form: NFKC, no invisible marks, look-alike letters as their Latin twins, lower case.

    Two texts that look alike get the same form. It is meant for keys, not for display: Cyrillic words
    lose their own letters too, the same ones everywhere. Null stays null.
    """
    shown = F.regexp_replace(c, f"[{INVISIBLE}]", "")
    odd = c.rlike("[^\\x00-\\x7F\\uAC00-\\uD7A3]")
    return F.lower(F.when(odd, F.translate(compose(F.coalesce(shown, F.lit(""))), LOOKALIKE_FROM, LOOKALIKE_TO)).otherwise(c))


def blank(c: Column) -> Column:
    """True where a text is null, empty, white space, ``x`` or ``none`` in any letter case."""
    return c.isNull() | F.lower(F.regexp_replace(c, "^[\\s\\u00A0\\u3000\\uFEFF]+|[\\s\\u00A0\\u3000\\uFEFF]+$", "")).isin("", "x", "none")
