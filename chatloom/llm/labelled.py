"""Documents whose kind is known, made from messages by known changes: what the rules of `quality` learn from.

The corpus has no labels of kind. But chat texts are prose, and the other kinds follow from what is done to them: their words one to a line are a list, the
columns of their table are rows of a table, their words in no order, their bytes read wrongly or their marks alone are junk. So the label of a made
document is certain and owes nothing to the statistics that the rules see.
"""

from __future__ import annotations

import base64
import hashlib
import random

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EMOJI = regex.compile(r"\p{Extended_Pictographic}️?|\p{Emoji_Modifier}")
_WORD = regex.compile(r"[\p{L}\p{M}']+")
_DAMAGE = "�ÃÂâ©€¤§¢¶"


def sample_messages(messages: DataFrame, sample_rows: int) -> list[dict]:
    """At most `sample_rows` messages of different texts, those of the least hashes, as rows of sender, lang, message, number; none of media or notices.

    As in `language.fit_languages`, hashes fall into buckets of which each gives its least, so the sample doesn't depend on the size of the table.
    """
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    said = messages.filter(off("is_system") & off("is_media") & off("is_deleted") & F.col("message").isNotNull())
    hashed = said.select(F.xxhash64("message").alias("h"), "row_id", "sender", "lang", "message", F.col("msg_id").alias("number"))
    least = hashed.groupBy(F.pmod("h", F.lit(16 * sample_rows)).alias("bucket")).agg(F.min("h").alias("h"))
    least = least.orderBy(F.xxhash64("h"), "h").limit(sample_rows).select("h")
    found = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min_by(F.struct("sender", "lang", "message", "number"), "row_id").alias("m"))
    return [r["m"].asDict() for r in found.orderBy("h").collect()]


class Maker:
    """Makes documents of each kind from sampled messages."""

    def __init__(self, rows: list[dict], seed: int = 11):
        self.rng = random.Random(seed)
        self.rows = [r for r in rows if r["message"] and r["message"].strip()]
        self.sentences = [r["message"].strip() for r in self.rows if len(r["message"].split()) >= 4]
        self.words = [w for s in self.sentences for w in _WORD.findall(s)]
        self.by_language: dict[str | None, list[str]] = {}
        for r in self.rows:
            self.by_language.setdefault(r["lang"], []).extend(_WORD.findall(r["message"]))
        self.by_language = {k: v for k, v in self.by_language.items() if k and len(set(v)) > 30} or {None: self.words}
        self.marked = [s for s in self.sentences if not s.isascii()]
        self.emoji = _EMOJI.findall(" ".join(s for s in self.marked)) or ["\U0001f600", "\U0001f389", "❤"]

    def _count(self, least: int, most: int) -> int:
        """Small numbers more often than large ones."""
        return least + int((most - least) * self.rng.random() ** 2)

    def _clock(self) -> str:
        return f"{self.rng.randrange(24):02}:{self.rng.randrange(60):02}"

    def _name(self) -> str:
        return regex.split(r"\s", (self.rng.choice(self.rows)["sender"] or "Someone").strip() or "Someone")[0][:20]

    def _heading(self) -> str:
        return " ".join(self.rng.choices(self.words, k=self.rng.randrange(1, 4))).capitalize()

    def prose(self) -> str:
        rng, way = self.rng, self.rng.randrange(5)
        said = [rng.choice(self.sentences) if rng.random() < 0.75 else rng.choice(self.rows)["message"].strip() for _ in range(self._count(1, 25))]
        said[0] = rng.choice(self.sentences)
        if way == 0:
            return "\n".join(said)
        if way in (1, 2):
            people = [self._name() for _ in range(rng.randrange(1, 5))]
            return "\n".join(f"{f'[{self._clock()}] ' if way == 1 else ''}{rng.choice(people)}: {s}" for s in said)
        flat = [" ".join(s.split()) for s in said]
        finished = rng.random() < 0.7
        flat = [s[:1].upper() + s[1:] + ("." if finished and s[-1].isalnum() else "") for s in flat] if finished else flat
        lines, at = [], 0
        while at < len(flat):
            k = rng.randrange(1, 8)
            lines.append(" ".join(flat[at : at + k]))
            at += k
        return "\n".join(([self._heading()] if rng.random() < 0.15 else []) + lines)

    def list(self) -> str:
        rng, n = self.rng, self._count(3, 40)
        items = []
        for _ in range(n):
            words = rng.choice(self.sentences).split()
            k, at = rng.choice([1, 1, 2, 2, 3]), rng.randrange(len(words))
            items.append(regex.sub(r"[^\p{L}\p{M}' ]", "", " ".join(words[at : at + k])).strip() or rng.choice(self.words))
        bullet = rng.choice(["- ", "• ", "* ", "{}. ", "{}) ", "[ ] ", "[x] ", "", "", ""])
        tail = " x{}" if not bullet and rng.random() < 0.3 else ""
        items = [bullet.replace("[x]", rng.choice(["[x]", "[ ]"])).format(i) + s + tail.format(rng.randrange(1, 9)) for i, s in enumerate(items, 1)]
        if rng.random() < 0.3:
            items.insert(0, self._heading() + ":")
        if rng.random() < 0.15 and n > 4:
            items.append(rng.choice(self.sentences))
        return ("; " if rng.random() < 0.2 else "\n").join(items)

    def table(self) -> str:
        rng = self.rng
        columns = [
            ("person", lambda r: self._name()), ("messages", lambda r: str(rng.randrange(1, 5000))), ("number", lambda r: str(r["number"])), ("share", lambda r: f"{100 * rng.random():.1f}%"),
            ("date", lambda r: f"{rng.randrange(2015, 2027)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}"), ("last", lambda r: rng.choice([self._clock(), "n/a", "-"])),
        ]
        columns = columns[: rng.randrange(3, len(columns) + 1)]
        rows = [[f(rng.choice(self.rows)) for _, f in columns] for _ in range(self._count(4, 30))]
        if rng.random() < 0.7:
            rows.insert(0, [name for name, _ in columns])
        way = rng.randrange(5)
        if way == 0:
            return "\n".join("".join(c.ljust(12) for c in row).rstrip() for row in rows)
        if way == 1:
            lines = [f"| {' | '.join(row)} |" for row in rows]
            return "\n".join([lines[0], f"| {' | '.join(['---'] * len(columns))} |", *lines[1:]])
        return "\n".join({2: "\t", 3: ";", 4: ", "}[way].join(row) for row in rows)

    def junk(self) -> str:
        rng, way, n = self.rng, self.rng.randrange(9), self._count(8, 150)
        if way in (0, 1):  # words in no order
            words = rng.choice([*self.by_language.values()])
            words = words if rng.random() < 0.5 else sorted(set(words))  # as often as they are said, or each alike
            return " ".join(rng.choices(words, k=n))
        if way == 2:  # bytes read in the wrong way
            text = " ".join(rng.choice(self.marked or ["été à Noël"]) for _ in range(rng.randrange(1, 4)))
            return text.encode().decode("cp1252", errors="replace") + "".join(rng.choices(_DAMAGE, k=n))
        if way == 3:
            return base64.b64encode(b"".join(hashlib.sha256(f"{rng.random()}".encode()).digest() for _ in range(1 + n // 20))).decode()
        if way == 4:
            return (rng.choice(["lol", "ok", "test", rng.choice(self.words)]) + " ") * n
        if way == 5:  # marks alone
            return "\n".join(rng.choice("-=_*.~#") * rng.randrange(8, 60) for _ in range(1 + n // 12))
        if way == 6:
            return "".join(rng.choices(self.emoji, k=n))
        if way == 7:
            return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(3, 14))) for _ in range(n))
        # what a page shows around its text
        parts = [rng.choice(self.words).capitalize() if rng.random() < 0.8 else " ".join(rng.choices(self.words, k=2)).capitalize() for _ in range(12)]
        return " | ".join(rng.choices(parts, k=n))


def labelled_documents(rows: list[dict], n: int = 10_000, seed: int = 11) -> list[tuple[str, str]]:
    """`n` made documents with their kinds, half of them prose. Without messages of four words or more there are none."""
    maker = Maker(rows, seed)
    if not maker.sentences:
        return []
    kinds = ["prose"] * 7 + ["list"] * 2 + ["table"] * 2 + ["junk"] * 3
    return [(getattr(maker, kind)(), kind) for kind in (kinds[i % len(kinds)] for i in range(n))]
