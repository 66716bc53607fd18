"""One consistent form for text that looks the same.

`normal_form` applies compatibility composition, maps look-alike letters inside words of mixed script,
drops default-ignorable characters, maps white space to the plain space and folds case in full.
Joiners and selectors stay where they belong to an emoji, joiners also inside Indic words.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts that are drawn like a Latin letter.
CYRILLIC_LOOKS = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԚԜаеѕіјкорсухԛԝһԁ",
        "ABESIJKMHOPCTYXQWaesijkopcyxqwhd",
        strict=True,
    )
)
GREEK_LOOKS = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανοριυκχϲϳ", "ABEZHIKMNOPTYXavopiukxcj", strict=True))
ARMENIAN_LOOKS = dict(zip("օոսցհ", "onugh", strict=True))
LATIN_LOOKS = {**CYRILLIC_LOOKS, **GREEK_LOOKS, **ARMENIAN_LOOKS, "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l"}
TO_CYRILLIC = {v: k for k, v in CYRILLIC_LOOKS.items()}
TO_CYRILLIC |= {g: TO_CYRILLIC[v] for g, v in GREEK_LOOKS.items() if v in TO_CYRILLIC}
TO_GREEK = {v: k for k, v in GREEK_LOOKS.items()}
TO_GREEK |= {c: TO_GREEK[v] for c, v in CYRILLIC_LOOKS.items() if v in TO_GREEK}

SPACES = "\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Default-ignorable characters, the byte-order mark included.
IGNORABLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\U000e0000-\U000e0fff"
EMOJI = r"\p{Extended_Pictographic}\p{Emoji_Modifier}\p{Regional_Indicator}"
INDIC = "\u0900-\u0df7"
_TAG = "\U000e0020-\U000e007f"
#: Ignorable characters that carry meaning where they stand.
_KEPT = "|".join(
    [
        rf"(?<=[{EMOJI}\ufe0f\u20e3{_TAG}])\u200d(?=[{EMOJI}])",
        rf"(?<=[{EMOJI}0-9#*])[\ufe0e\ufe0f]",
        rf"(?<=[{EMOJI}{_TAG}])[{_TAG}]",
        rf"(?<=[{INDIC}])[\u200c\u200d](?=[{INDIC}])",
    ]
)
_INVISIBLE = regex.compile(rf"(?:{_KEPT})(*SKIP)(*FAIL)|[{IGNORABLE}]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_FOREIGN = regex.compile(r"[\p{Script=Cyrillic}\p{Script=Greek}\p{Script=Armenian}ıɑɡⅼ]")
SCRIPTS = {s: regex.compile(rf"\p{{Script={s}}}") for s in ("Latin", "Cyrillic", "Greek", "Armenian", "Hebrew", "Arabic", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Tamil", "Telugu", "Kannada", "Malayalam", "Thai", "Georgian", "Hangul", "Cherokee")}


@lru_cache(maxsize=1 << 16)
def scripts_of(word: str) -> tuple[tuple[str, int], ...]:
    """Scripts of the letters of a word with their counts, the most frequent first, Latin first on ties."""
    found = [(name, n) for name, rx in SCRIPTS.items() if (n := len(rx.findall(word)))]
    return tuple(sorted(found, key=lambda x: -x[1]))


def unify_word(word: str) -> str:
    """A word of mixed script in its main script, letter for letter; other words as they are."""
    found = scripts_of(word)
    if len(found) < 2:
        return word
    table = {"Latin": LATIN_LOOKS, "Cyrillic": TO_CYRILLIC, "Greek": TO_GREEK}.get(found[0][0])
    return "".join(table.get(c, c) for c in word) if table else word


def unify_scripts(text: str) -> str:
    if not _FOREIGN.search(text):
        return text
    return _WORD.sub(lambda m: unify_word(m.group(0)), text)


def strip_invisible(text: str) -> str:
    return _INVISIBLE.sub("", text)


#: Characters that the form leaves as they are but for case and white space.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00de\u00e0-\u00f6\u00f8-\u012f\u0134-\u013e\u0141-\u0148\u014a-\u017e"
_CYRILLIC, _DEVANAGARI = "\u0400-\u045f", "\u0900-\u0928\u092a-\u0930\u0932\u0933\u0935-\u0939\u093d-\u0950\u0960-\u096f"
_SIGNS = "\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf\u00d7\u2013\u2014\u2018-\u201d\u2022\u20ac\u20b9\u2190-\u2194\u2600-\u2767\U0001f300-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff"
_OTHER = re.compile(rf"[^\t\n\r\x20-\x40\x5b-\x60\x7b-\x7e{_LATIN}{_CYRILLIC}{_DEVANAGARI}{_SIGNS}\ufe0f\u200d]")
_ALONE = regex.compile(rf"(?<![{EMOJI}])\ufe0f|(?<![{EMOJI}\ufe0f])\u200d|\u200d(?![{EMOJI}])")
_BESIDE = re.compile("|".join(f"[{a}](?=[{b}])" for a, b in ((_LATIN, _CYRILLIC + _DEVANAGARI), (_CYRILLIC, _LATIN + _DEVANAGARI), (_DEVANAGARI, _LATIN + _CYRILLIC))))
_ELSEWHERE = re.compile("[\u0400-\u097f]")


def is_settled(text: str) -> bool:
    """Whether lower case and plain spaces alone give the form: characters that the form keeps, no selector or joiner that stands alone, no two scripts side by side."""
    if _OTHER.search(text):
        return False
    if ("\ufe0f" in text or "\u200d" in text) and _ALONE.search(text):
        return False
    return not (_ELSEWHERE.search(text) and _BESIDE.search(text))


def normal_form(text: str | None, fold: bool = True) -> str | None:
    """The one form of a text; None stays None. Line breaks and tabs become plain spaces."""
    if text is None:
        return None
    if not (text.isascii() or is_settled(text)):
        text = unicodedata.normalize("NFKC", strip_invisible(text))
        text = unify_scripts(text)
        if fold:
            text = unicodedata.normalize("NFKC", text.casefold())
    elif fold:
        text = text.lower()
    # white space of any kind parts the words
    return " ".join(text.split())


def per_distinct(values: pd.Series, fn) -> pd.Series:
    """`fn` once for each distinct value of the batch."""
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    out = [fn(v) for v in distinct]
    return pd.Series([out[c] if c >= 0 else None for c in codes], index=values.index, dtype=object)


@F.pandas_udf(StringType())
def _normal_form_udf(values: pd.Series) -> pd.Series:
    return per_distinct(values, normal_form)


def normal_key(col: Column) -> Column:
    """The form under which senders of one chat are the same person, and equal texts equal; null for null. Plain ASCII values never reach Python."""
    plain = F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))
    return F.coalesce(_normal_form_udf(F.when(col.rlike(r"[^\t\n\r\x20-\x7e]"), col)), plain)
