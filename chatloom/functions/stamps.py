"""Reading of written dates and times as native column expressions.

Every function returns Columns; nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chatloom.functions.textform import LATIN_LOOKS

# English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH_NAMES = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Zone abbreviations that name one offset, in minutes.
ZONE_MINUTES = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "gst": 240, "ist": 330, "npt": 345, "aest": 600, "aedt": 660, "nst": -210, "ndt": -150, "ast": -240, "adt": -180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
#: Zero code points of digit rows that phones write instead of ASCII digits.
DIGIT_ROWS = [0x0660, 0x06F0, 0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0xFF10]
_SPACES = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x09]))
_DROPPED = "".join(map(chr, [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFE0E, 0xFE0F, 0xFEFF]))
_DASHES = "".join(map(chr, [*range(0x2010, 0x2016), 0x2212]))


def _char_map() -> tuple[str, str]:
    pairs = {chr(z + i): str(i) for z in DIGIT_ROWS for i in range(10)}
    pairs |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= dict.fromkeys(_SPACES, " ") | dict.fromkeys(_DASHES, "-")
    pairs |= {k: v for k, v in LATIN_LOOKS.items() if len(k) == 1}
    return "".join(pairs) + _DROPPED, "".join(pairs.values())


def clean_stamp(col: Column) -> Column:
    """Lower case with ASCII digits, plain spaces and no invisible characters."""
    src, dst = _char_map()
    plain = F.when(col.rlike(r"[^\x20-\x7e]"), F.translate(col, src, dst)).otherwise(col)
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def whole(col: Column) -> Column:
    """A text of up to nine digits as a number, null for any other: a cast that fails inside Spark costs an exception for each value."""
    return F.when(col.rlike(r"^[0-9]{1,9}$"), col.cast("int"))


def _lookup(values: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def epoch_day(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a real date, null otherwise."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.when((y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last), F.unix_date(F.make_date(y, m, d)).cast("bigint"))


NUMERIC = r"^(\d{1,2})([-/.])(\d{1,2})\2(\d{4}|\d{2})$"
YEAR_FIRST = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})$"
DAY_NAME = r"^(\d{1,2})\.? ([a-z]+)\.?,? (\d{4}|\d{2})$"
NAME_DAY = r"^([a-z]+)\.? (\d{1,2}),? (\d{4}|\d{2})$"
ISO = r"^(\d{4})-(\d{2})-(\d{2})[t ](\d{2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?(?: ?(z|[+-]\d{2}(?::?\d{2})?))?$"
COUNT = r"^(\d{9,14})$"
CLOCK = r"^(\d{1,2})[:.](\d{2})(?:[:.](\d{2})(?:[.,]\d+)?)?(?: ?([ap])\.? ?m\.?)?(?: ?((?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,5}))?$"
OFFSET = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"


def full_year(y: Column) -> Column:
    return F.when(y < 100, y + 2000).otherwise(y)


#: Ways to write a date, with the parts that each gives: year, month, day where the way fixes them (an iso date adds hour, minute, second, zone),
#: the three numbers as they stand where it is numeric.
SHAPES = [
    ("count", COUNT, "$1"), ("iso", ISO, "$1|$2|$3|$4|$5|$6|$7"), ("year_first", YEAR_FIRST, "$1|$3|$4"),
    ("numeric", NUMERIC, "$1|$3|$4"), ("day_name", DAY_NAME, "$3|$2|$1"), ("name_day", NAME_DAY, "$3|$1|$2"),
]


def date_parts(d: Column) -> Column:
    """Array of the way a cleaned date is written and its parts, null where it can't be read."""
    out = F.when(~d.contains("|"), d)
    for name, pattern, parts in SHAPES:
        out = F.regexp_replace(out, pattern, f"{name}|{parts}")
    return F.split(out, r"\|")


def month_number(written: Column) -> Column:
    """A month written as a number or by its English name."""
    names = {n: i for i, both in enumerate(zip(MONTHS, MONTH_NAMES, strict=True), 1) for n in both} | {"sept": 9}
    return F.when(written.rlike("^[0-9]"), whole(written)).otherwise(_lookup(names, written))


def ordered_days(n1: Column, n2: Column, n3: Column) -> dict[str, Column]:
    """The day that three numbers name under each order, null where they name none; years of two digits are 20yy."""
    y3 = full_year(n3)
    return {"dmy": epoch_day(y3, n2, n1), "mdy": epoch_day(y3, n1, n2), "ymd": epoch_day(full_year(n1), n2, F.when(n3 < 100, n3))}


def clock_parts(t: Column) -> Column:
    """Array of hour, minute, second, half of the day, zone of a cleaned time; null where it isn't one."""
    parts = F.split(F.regexp_replace(F.when(~t.contains("|"), t), CLOCK, "$1|$2|$3|$4|$5"), r"\|")
    return F.when(F.size(parts) == 5, parts)


def second_of_day(h: Column, mi: Column, s: Column, half: Column) -> Column:
    hour = F.when(half == "", F.when(h <= 23, h)).when(h.between(1, 12), h % 12 + F.when(half == "p", 12).otherwise(0))
    return F.when((mi <= 59) & (F.coalesce(s, F.lit(0)) <= 59), hour * 3600 + mi * 60 + F.coalesce(s, F.lit(0)))


def offset_parts(zone: Column) -> Column:
    """Array of sign, hours, minutes of a zone written as an offset, of fewer parts for any other."""
    return F.split(F.regexp_replace(zone, OFFSET, "$1|$2|$3"), r"\|")


def offset_seconds(zone: Column, parts: Column) -> Column:
    """Seconds east of UTC for a written zone and its `offset_parts`; null where it isn't one."""
    hours, rest = whole(F.get(parts, F.lit(1))), F.coalesce(whole(F.get(parts, F.lit(2))), F.lit(0))
    seconds = (hours * 60 + rest) * F.when(parts[0] == "-", -60).otherwise(60)
    signed = F.when((hours <= 14) & (rest < 60), seconds)
    return F.when(F.size(parts) == 3, signed).otherwise(_lookup({k: v * 60 for k, v in ZONE_MINUTES.items()}, zone))


def zone_offset(zone: Column, utc_second: Column) -> Column:
    """Offset of a named zone at an instant, in seconds, whatever the session's own zone."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(utc_second), zone)) - utc_second
