"""Personal information inside free text: find it, and put typed placeholders in its place.

Method: regular expressions propose spans, checksum validators (Luhn, Verhoeff, mod-97) confirm or weaken them, context
words nearby adjust the score; spans above the threshold stand, the best of overlapping ones.

A text is read in a shadow of plain characters (ASCII digits, no invisible marks, look-alikes unified) whose every
character knows its place in the original, so a found piece comes out exactly as it is written. Native code first keeps
only texts that hold a digit, an at sign or two capitalised words; each distinct text of a batch is read once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Container
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions import textform
from chatloom.functions.textform import per_distinct
from chatloom.session import materialize

THRESHOLD = 0.5
#: What a given name that people in the corpus bear adds to the score of a name.
KNOWN_NAME = 0.35
#: Given names that every task holds at most; rarer ones are joined to the texts whose names hang on them.
SHARED_NAMES = 200_000
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}

_SP = r"[ \n\t]"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT = rf"(?:{_SP}+(?:at|arroba|\(at\)|\[at\]|\{{at\}}){_SP}+|{_SP}?[\(\[]at[\)\]]{_SP}?)"
_DOT = rf"(?:{_SP}+(?:dot|punto|ponto|punkt|point|\(dot\)|\[dot\]){_SP}+|{_SP}?[\(\[]dot[\)\]]{_SP}?)"
_LOCAL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*"
#: Written with signs, or with words for both signs.
EMAIL = regex.compile(
    rf"{_LOCAL}(?:@{_LABEL}(?:\.{_LABEL})*\.[A-Za-z]{{2,}}|(?:@|{_AT}){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}})(?![\p{{L}}\p{{N}}])"
)
LINK = regex.compile(r"(?:https?://|www\.)\S+")
#: Digits in groups, with the signs that phones and identity numbers hold.
NUMBER = regex.compile(r"(?<![\p{L}\p{N}+$€£₹#@/.:-])(?:\+\d{1,3}|\(\d{2,5}\)|\d+)(?:[ .\-]?(?:\(\d{2,5}\)|\d+))*(?![\p{L}\p{N}%]|[.:,/-]\d)")
LETTERED_ID = regex.compile(r"(?<![\p{L}\p{N}-])(?:[A-Z]{5}\d{4}[A-Z]|[A-Z]\d{7,8}|[A-Z]{2}\d{6,7}|\d{8}[A-Z]|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![\p{L}\p{N}-])")
_CAP = r"\p{Lu}[\p{L}\p{M}'’-]*"
_STREET = rf"{_CAP}(?:{_SP}+(?:(?:de|da|do|del|la|der|den|dem|von|of|the|du|des){_SP}+)?{_CAP}){{0,4}}"
_TOWN = rf"{_CAP}(?:{_SP}+{_CAP})?"
ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:"
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|House){_SP}+[\dA-Z-]+,{_SP}*)?\d{{1,5}}[A-Za-z]?,?{_SP}+{_STREET},{_SP}*{_TOWN},?{_SP}+\d{{4,6}}(?!\d)"
    rf"|(?:H\.?{_SP}?No\.?|House{_SP}No\.?|Plot{_SP}No\.?|Door{_SP}No\.?){_SP}*[\d/-]+[A-Z]?,{_SP}*{_STREET}(?:,{_SP}*{_STREET})?,{_SP}*{_TOWN},?{_SP}+\d{{5,6}}(?!\d)"
    rf"|{_STREET}{_SP}+\d{{1,5}}[a-zA-Z]?,{_SP}*\d{{4,6}}{_SP}+{_TOWN}"
    rf")"
)
NAME = regex.compile(rf"(?<![\p{{L}}\p{{N}}@._-])({_CAP}){_SP}+(?:\p{{Lu}}\.?{_SP}+)?({_CAP})(?![\p{{L}}\p{{N}}])")
#: Words before or after a span that speak for a kind, in the seven languages of the data.
BEFORE = {
    "phone": "call ring phone mobile whatsapp reach number text dial llámame llama teléfono número ligue liga telefone ruf anrufen nummer telefon handy appelle téléphone numéro नंबर फोन कॉल номер звони телефон".split(),
    "id_number": "id passport card document form ssn licence license aadhaar pan documento dni pasaporte identidad identidade cpf ausweis ausweisnummer pass reisepass d'identité carte passeport पहचान आधार документа документ паспорт".split(),
    "name": "mr mrs ms dr ask spoke with under booking see meet call to señor señora sr sra por nombre pregunta reserva procura nome senhor senhora nach auf herr frau buchung demande nom monsieur madame पर नाम से श्री спроси там имя зовут".split(),
}
AFTER = {"name": "yesterday will at en na am à से will's на ist está".split(), "phone": "tonight urgent esta hoje heute ce है".split(), "id_number": ["है"]}
AGAINST = {
    "number": "order parcel invoice flight room km inv trk booking-no ref version v pedido factura vuelo bestellung rechnung flug zimmer commande facture vol chambre vôo quarto заказ рейс комната".split(),
}
#: Articles, alone or grown together with a preposition, that stand before nouns and hardly before names.
ARTICLES = set("the der die das dem den des ein eine einen einem einer im am zum zur vom beim".split())
#: Capitalised words that begin a sentence or name a thing, not a given name.
NOT_GIVEN = set(
 "the a an my our his her their this that it if we you they i well just oh guess quick sorry by honestly please nobody did could let what no some any so and but or calle plaza rua rue avenida am an der die das den dem des ein eine einen meine mein unser der wenn ich wir es hat hast hat kannst bitte wie sag street road hill lane court row avenue town lake north south east west old new saint san santa flat house friday saturday sunday monday tuesday wednesday thursday january february march april may june july august september october november december si se por para mi nos el la los las un una le les je il elle on tu vous nous dis bon donc mon ma mes o os as eu ele ela você minha meu week dear hello hi".split()
)
NOT_FAMILY = set("street road hill lane court row avenue drive line fest festival club group office team gym school class family chat bank station the nobody just we if it they my please what friday saturday sunday monday tuesday wednesday thursday".split())


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


# The multiplication of the dihedral group of order ten, and the permutation of the check.
_D5 = [[(a + b) % 5 if a < 5 and b < 5 else 5 + (a + b - 5) % 5 if a < 5 else 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5 for b in range(10)] for a in range(10)]
_PERMUTE = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def verhoeff(digits: str) -> bool:
    check, powers = 0, list(range(10))
    for d in map(int, reversed(digits)):
        check = _D5[check][powers[d]]
        powers = [_PERMUTE[p] for p in powers]
    return check == 0


def mod97(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    kind: str
    score: float


def shadow(text: str) -> tuple[str, list[int] | None]:
    """The text in plain characters, and for each of them its place in the original (None: the same)."""
    if text.isascii():
        return text, None
    gone = {i for m in textform._INVISIBLE.finditer(text) for i in range(*m.span())}
    out, at = [], []
    for i, c in enumerate(text):
        if i in gone:
            continue
        if c.isascii():
            out.append(c)
            at.append(i)
            continue
        kind = unicodedata.category(c)
        plain = str(unicodedata.decimal(c)) if kind == "Nd" else " " if kind == "Zs" else "-" if kind == "Pd" else unicodedata.normalize("NFKC", c)
        out.append(plain)
        at.extend([i] * len(plain))
    plain = "".join(out)
    return textform.unify_scripts(plain), at


def _words_before(text: str, start: int, reach: int = 40) -> list[str]:
    part = regex.split(r"[;.!?](?=\s)| - |\n", text[max(0, start - reach) : start])[-1]
    return regex.findall(r"[\p{L}\p{M}'’]+", part.lower())[-5:]


def _words_after(text: str, end: int, reach: int = 30) -> list[str]:
    return regex.findall(r"[\p{L}\p{M}']+", text[end : end + reach].lower())[:3]


def _number_kind(text: str, start: int, end: int) -> Span | None:
    raw = text[start:end]
    digits = regex.sub(r"\D", "", raw)
    n, grouped = len(digits), [len(g) for g in regex.findall(r"\d+", raw)]
    before, after = _words_before(text, start), _words_after(text, end)
    phone = identity = 0.0
    if raw.startswith("+") and 9 <= n <= 15:
        phone = 0.9
    elif regex.fullmatch(r"\(\d{3}\) ?\d{3}[- .]\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4}|0\d{4} ?\d{6}|0\d{2,5}[- ]\d{5,8}|0\d{2} \d{4,5} \d{3,4}|\d{5} \d{5}", raw):
        phone = 0.7
    elif n == 10 and grouped == [10] and digits[0] in "56789":
        phone = 0.5
    elif 7 <= n <= 12 and len(grouped) > 1:
        phone = 0.2
    if grouped == [4, 4, 4] or grouped == [12]:
        identity = 0.5 + 0.2 * (verhoeff(digits) or luhn(digits))
    elif grouped == [3, 2, 4] and "." not in raw:
        identity = 0.7
    elif grouped == [4, 4, 4, 4] or grouped == [16]:
        identity = 0.45 + 0.3 * luhn(digits)
    elif grouped == [3, 3, 3, 2] and n == 11:
        identity = 0.5
    elif 8 <= n <= 14 and len(grouped) == 1:
        identity = 0.15
    says = lambda kind: 0.3 * any(w in BEFORE[kind] for w in before) + 0.1 * any(w in AFTER[kind] for w in after)
    phone, identity = phone and phone + says("phone"), identity and identity + says("id_number")
    if before[-1:] and before[-1] in AGAINST["number"]:
        phone, identity = phone - 0.6, identity - 0.6
    if max(phone, identity) < THRESHOLD:
        return None
    return Span(start, end, "phone", phone) if phone >= identity else Span(start, end, "id_number", identity)


def _name(text: str, m: regex.Match, given_names: Container[str], open_names: set[str]) -> Span | None:
    start, end = m.span()
    given, family = m.group(1), m.group(2)
    ending = regex.search(r"['’]s?$", family)
    if ending:
        end -= len(ending.group(0))
        family = family[: -len(ending.group(0))]
    if len(given) < 2 or len(family) < 2 or family.isupper() or given.lower() in NOT_GIVEN or family.lower() in NOT_FAMILY:
        return None
    score = 0.3
    before, after = _words_before(text, start), _words_after(text, end)
    known = given.lower() in given_names
    if before[-1:] and before[-1] in ARTICLES and not known:
        open_names.add(given.lower())
        return None  # a noun, in a language that writes nouns with capitals
    if known:
        score += KNOWN_NAME
    if any(w in BEFORE["name"] for w in before[-2:]):
        score += 0.25
    if ending or (after[:1] and after[0] in AFTER["name"]):
        score += 0.15
    if regex.match(r" *\d", text[end:]):
        score -= 0.4
    if score < THRESHOLD <= score + KNOWN_NAME and not known:
        open_names.add(given.lower())
    return Span(start, end, "name", score) if score >= THRESHOLD else None


def find_spans(text: str, given_names: Container[str] = frozenset(), open_names: set[str] | None = None) -> list[tuple[str, str, int, int]]:
    """(kind, piece, start, end) in order; spans don't overlap. Offsets are code points of the text. `open_names` gets the given names, not among `given_names`,
    that would make a name of what isn't one without."""
    open_names = set() if open_names is None else open_names
    plain, at = shadow(text)
    links = [m.span() for m in LINK.finditer(plain)]
    spans = [Span(*m.span(), "email", 1.0) for m in EMAIL.finditer(plain)]
    spans += [Span(*m.span(), "address", 0.95) for m in ADDRESS.finditer(plain)]
    for m in LETTERED_ID.finditer(plain):
        code = m.group(0).replace(" ", "")
        long_code = len(code) > 12
        said = any(w in BEFORE["id_number"] for w in _words_before(plain, m.start()))
        score = (0.3 + 0.5 * mod97(code) if long_code else 0.55) + 0.3 * said
        if score >= THRESHOLD:
            spans.append(Span(*m.span(), "id_number", score))
    for m in NUMBER.finditer(plain):
        # numbers that stand side by side are tried as one, then apart
        found = _number_kind(plain, *m.span())
        if found is None:
            continue
        spans.append(found)
    spans += [s for m in NAME.finditer(plain, overlapped=True) if (s := _name(plain, m, given_names, open_names))]
    chosen: list[Span] = []
    for s in sorted(spans, key=lambda s: (-s.score, s.start, -s.end)):
        if all(s.end <= c.start or s.start >= c.end for c in chosen) and not any(s.start < b and s.end > a for a, b in links):
            chosen.append(s)
    out = []
    for s in sorted(chosen, key=lambda s: s.start):
        a, b = (s.start, s.end) if at is None else (at[s.start], at[s.end - 1] + 1)
        # marks that combine with the last letter belong to it
        while b < len(text) and unicodedata.combining(text[b]):
            b += 1
        out.append((s.kind, text[a:b], a, b))
    return out


def redact(text: str, spans: list[tuple[str, str, int, int]]) -> str:
    out, last = [], 0
    for kind, _, a, b in spans:
        out += [text[last:a], PLACEHOLDER[kind]]
        last = b
    return "".join([*out, text[last:]])


#: A text that can hold personal data at all: a digit, an at sign, or two capitalised words in a row.
_SUSPECT = r"[\p{Nd}@\x{FF20}]|\p{Lu}[\p{L}\p{M}\p{Cf}'’-]*[\p{Z}\s\p{Cf}]+\p{Lu}|(?i:[\(\[]at[\)\]]|\Wat\W.*\Wdot\W)"
FOUND = "ARRAY<STRUCT<kind: STRING, piece: STRING, start: INT, stop: INT>>"


def known_given_names(senders: DataFrame, column: str = "sender", least: int = 2) -> DataFrame:
    """Given names that senders bear, `name` in lower case with its `count`: the first word of `Given Family` that stands in at least `least` rows."""
    first = F.lower(F.regexp_extract(F.col(column), r"^\s*(\p{Lu}[\p{L}\p{M}]+)\s+\p{Lu}[\p{L}\p{M}]+\s*$", 1)).alias("name")
    return senders.select(first).filter((F.col("name") != "") & ~F.col("name").isin(*sorted(NOT_GIVEN))).groupBy("name").count().filter(F.col("count") >= least)


_JUDGED = f"found {FOUND}, redacted STRING, open ARRAY<STRING>"


def _judge(text: str | None, names: Container[str]) -> tuple:
    missing: set[str] = set()
    spans = find_spans(text, names, missing)
    return [dict(zip(("kind", "piece", "start", "stop"), s, strict=True)) for s in spans], redact(text, spans), sorted(missing)


def _judged(rows: DataFrame, text: str, names: DataFrame | Container[str], most: int) -> DataFrame:
    """`rows` with `_judged` (found, redacted). The most frequent names go to all tasks, `most` at most; the rest, if there are more, are joined by name to
    the texts in which a name hangs on one of them, and these texts are read again."""
    spark, rest = rows.sparkSession, None
    if isinstance(names, DataFrame):
        ordered = names.orderBy(F.desc("count"), "name")
        shown = [r["name"] for r in ordered.limit(most + 1).collect()]
        rest = ordered.offset(most).select("name") if len(shown) > most else None
        names = frozenset(shown[:most])
    shared = spark.sparkContext.broadcast(names)

    @F.pandas_udf(_JUDGED)
    def judge(values: pd.Series) -> pd.DataFrame:
        known = shared.value
        out = per_distinct(values, lambda t: _judge(t, known))
        return pd.DataFrame([x if x is not None else (None, None, None) for x in out], columns=["found", "redacted", "open"])

    judged = rows.withColumn("_judged", judge(F.when(F.col(text).rlike(_SUSPECT), F.col(text))))
    if rest is None:
        return judged

    @F.pandas_udf(_JUDGED)
    def again(values: pd.Series, more: pd.Series) -> pd.DataFrame:
        known = shared.value
        out = [(None, None, None) if t is None else _judge(t, known | set(extra)) for t, extra in zip(values, more, strict=True)]
        return pd.DataFrame(out, columns=["found", "redacted", "open"])

    judged = materialize(judged.withColumn("_uid", F.monotonically_increasing_id()), "judged")
    told = judged.select("_uid", F.explode("_judged.open").alias("name")).join(rest, "name").groupBy("_uid").agg(F.collect_set("name").alias("_more"))
    both = judged.join(told, "_uid", "left")
    second = again(F.when(F.col("_more").isNotNull(), F.col(text)), F.coalesce("_more", F.array().cast("array<string>")))
    return both.withColumn("_second", second).withColumn("_judged", F.when(F.col("_more").isNotNull(), F.col("_second")).otherwise(F.col("_judged"))).drop("_uid", "_more", "_second")


def find_pii(rows: DataFrame, text: str, given_names: DataFrame | Container[str] = frozenset(), most: int = SHARED_NAMES) -> DataFrame:
    """`rows` with `found` (kind, piece, start, stop) for texts that hold an item; others, null and empty texts have none and are left out.

    `given_names` is a set of lower-case names or a table of them (see `known_given_names`) of any size."""
    suspects = rows.filter(F.col(text).rlike(_SUSPECT))
    judged = _judged(suspects.drop("found"), text, given_names, most)
    return judged.withColumn("found", F.col("_judged.found")).drop("_judged").filter(F.size("found") > 0)


def redact_column(rows: DataFrame, text: str, given_names: DataFrame | Container[str] = frozenset(), most: int = SHARED_NAMES) -> DataFrame:
    """`rows` with `<text>_redacted`: typed placeholders for items, the rest as it stands; null stays null."""
    judged = _judged(rows, text, given_names, most)
    return judged.withColumn(f"{text}_redacted", F.coalesce("_judged.redacted", F.col(text))).drop("_judged")
