"""Visually identical text with different characters: one form for comparison, and what had to change.

Method: compatibility normalisation in composed form, full case folding, mapped white space and removal of
default-ignorable characters, for each distinct value of an Arrow batch. Plain ASCII values never reach Python for
the finding of defects; native code settles them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from chatloom.functions import textform
from chatloom.functions.textform import normal_key, per_distinct

_WIDE = regex.compile("[！-～｡-ￜ￠-￮]")
_LIGATURE = regex.compile("[ﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳ]")
_ODD_SPACE = regex.compile(f"[{textform.SPACES}]")
_APART = regex.compile(r"\P{M}\p{M}+")
_LETTERS = regex.compile(r"[\p{L}\p{M}]+")
#: Scripts that are written together in one word.
_TOGETHER = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


def _accent_apart(text: str) -> bool:
    if unicodedata.is_normalized("NFC", text):
        return False
    return any(len(unicodedata.normalize("NFC", m)) < len(m) for m in _APART.findall(text))


def _mixed_script(text: str) -> bool:
    plain = unicodedata.normalize("NFKC", textform.strip_invisible(text))
    return any(not w.isascii() and len(textform.scripts_of(w)) > 1 and not _TOGETHER.search(w) for w in _LETTERS.findall(plain))


def plain_form(text: str) -> str:
    """The one form of a text but for case and for what a writer sees as white space: odd spaces become plain ones, line breaks and tabs stay."""
    if text.isascii() or textform.is_settled(text):
        return text
    form = textform.unify_scripts(unicodedata.normalize("NFKC", textform.strip_invisible(text)))
    return _ODD_SPACE.sub(" ", form)


def defects(text: str | None) -> list[str] | None:
    """Kinds of characters that make a text differ from what it looks like; None for null, empty for none.

    The form decides: a text that equals its `plain_form` has none. What the form changes is then told apart, since it also unfolds characters that are no
    defect, such as fractions and raised digits. A word of two scripts is one even where no letter of the main script looks like its strange ones.
    """
    if text is None:
        return None
    if plain_form(text) == text and not _strange_word(text):
        return []
    found = [name for name, rx in (("full_width", _WIDE), ("ligature", _LIGATURE), ("space", _ODD_SPACE)) if rx.search(text)]
    if textform._INVISIBLE.search(text):
        found.append("invisible")
    if _accent_apart(text):
        found.append("accent_apart")
    if _mixed_script(text):
        found.append("mixed_script")
    return found


def _strange_word(text: str) -> bool:
    return not text.isascii() and not textform.is_settled(text) and _mixed_script(text)


@F.pandas_udf(ArrayType(StringType()))
def _defects_udf(values: pd.Series) -> pd.Series:
    return per_distinct(values, defects)


def find_lookalikes(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row (key, field, defects) for each value that holds a defect. Null, empty and ASCII values hold none.

    Rows with a repeated key come out for each; a column of `rows` named like a result plays no part.
    """
    suspects = rows.select(F.col(key), *[F.when(F.col(f).rlike(r"[^\x00-\x7f]"), F.col(f)).alias(f"_{f}") for f in fields])
    suspects = suspects.filter(F.coalesce(*[F.col(f"_{f}") for f in fields]).isNotNull())
    long = suspects.select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_{f}").alias("_value")) for f in fields])))
    judged = long.filter(F.col("_value").isNotNull()).withColumn("defects", _defects_udf(F.col("_value")))
    return judged.filter(F.size("defects") > 0).select(key, "field", "defects")


def normalise(rows: DataFrame, fields: list[str]) -> DataFrame:
    """`rows` with `<field>_normal` for each field; null stays null, a blank text becomes empty."""
    return rows.withColumns({f"{f}_normal": normal_key(F.col(f)) for f in fields})
