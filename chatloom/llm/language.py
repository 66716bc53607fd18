"""Missing or wrong language labels: a language and a confidence for each message and each line.

Method: prediction by partial matching. A tree of byte contexts of variable order per language, with escape
probabilities (escape method C), is fitted once on a bounded sample of labelled rows; under these frozen
statistics every text has an exact code length in each language, and the shortest wins.

The union of all trees is laid out as sorted arrays of 64-bit keys (order, context bytes, next byte), so that a
whole Arrow batch is scored by array look-ups: at each position the highest order whose context continues with
the byte gives the cost, orders above it add their escape costs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.functions.textform import normal_form

MAX_ORDER = 5
DEPENDENCE = 4.0
#: Scored texts that a task keeps, so that a text that comes again is not scored again.
KNOWN = 50_000
_NOISE = re.compile(r"\S*[@\d]\S*|https?://\S+|www\.\S+")
_MAYBE_NOISE = re.compile(r"[@\d]|https?://|www\.")
#: White space as a writer sees it; a line break never occurs within a line.
LINE_BREAK = r"\r\n|[\r\n\x{0B}\x{0C}\x{85}\x{2028}\x{2029}]"
WORD_GAP = r"[\s\p{Z}\x{1C}-\x{1F}\x{85}]+"


class _Letters(dict):
    """Letters, marks and apostrophes as they are, any other character as a space; each is looked up once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = c if c in "'’" or unicodedata.category(c)[0] in "LM" else " "
        return self[code]


_LETTERS = _Letters()


def letters_only(text: str) -> str:
    """Words of a text in one form; addresses, numbers, signs and emoji say nothing about the language."""
    form = normal_form(text)
    if _MAYBE_NOISE.search(form):
        form = _NOISE.sub(" ", form)
    return " ".join(form.translate(_LETTERS).split())


def _encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the padded texts in one array, and where each text starts."""
    raw = [f" {t} ".encode() for t in texts]
    lengths = np.fromiter((len(r) for r in raw), dtype=np.int64, count=len(raw))
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum(lengths)])


def _contexts(data: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the last bytes before each position as one number; how many bytes of context there are."""
    n = len(data)
    within = np.arange(n) - np.repeat(starts[:-1], np.diff(starts))
    contexts, now = [np.zeros(n, dtype=np.int64)], np.zeros(n, dtype=np.int64)
    for order in range(1, MAX_ORDER + 1):
        back = np.zeros(n, dtype=np.int64)
        back[order:] = data[:-order] if order else data
        now = now | back << np.int64(8 * (order - 1))
        contexts.append(now.copy())
    return contexts, within


@dataclass
class ContextTrees:
    """Frozen statistics of all languages: costs in bits by (context, byte), escape costs by context."""

    languages: list[str]
    symbol_keys: list[np.ndarray]
    symbol_bits: list[np.ndarray]
    context_keys: list[np.ndarray]
    escape_bits: list[np.ndarray]
    tables: list[tuple[_Places, _Places]] = field(default_factory=list)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "tables": []}  # made where they are used

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> ContextTrees:
        languages = sorted(set(labels))
        label_of = np.array([languages.index(x) for x in labels])
        data, starts = _encode(texts)
        contexts, within = _contexts(data, starts)
        lang = np.repeat(label_of, np.diff(starts))
        width, trees = len(languages), cls(languages, [], [], [], [])
        lower = np.full((256, width), 8.0, dtype=np.float32)  # below order 0: all bytes alike
        for order in range(MAX_ORDER + 1):
            there = within >= order
            key = contexts[order][there] << np.int64(8) | data[there].astype(np.int64)
            keys, at = np.unique(key, return_inverse=True)
            counts = np.bincount(at * width + lang[there], minlength=len(keys) * width).reshape(-1, width).astype(np.float64)
            # keys are in order, so those of one context lie together
            ctx, begins, ctx_at = np.unique(keys >> np.int64(8), return_index=True, return_inverse=True)
            total, kinds = np.add.reduceat(counts, begins, axis=0), np.add.reduceat((counts > 0).astype(np.float64), begins, axis=0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(counts / (total + kinds)[ctx_at])
            # a language that lacks the byte here escapes to its shorter context
            if order == 0:
                shorter = lower[keys & 255]
            else:
                short_key = keys & np.int64((1 << 8 * order) - 1)
                shorter = trees.symbol_bits[order - 1][np.searchsorted(trees.symbol_keys[order - 1], short_key)]
            bits = np.where(counts > 0, direct, escape[ctx_at] + shorter)
            trees.symbol_keys.append(keys)
            trees.symbol_bits.append(bits.astype(np.float32))
            trees.context_keys.append(ctx)
            trees.escape_bits.append(escape.astype(np.float32))
        return trees

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text in each language."""
        data, starts = _encode(texts)
        if not texts:
            return np.zeros((0, len(self.languages)))
        if not self.tables:
            self.tables = [(_Places(s), _Places(c)) for s, c in zip(self.symbol_keys, self.context_keys, strict=True)]
        contexts, within = _contexts(data, starts)
        bits = np.zeros((len(data), len(self.languages)), dtype=np.float32)
        left = np.arange(len(data))
        for order in range(MAX_ORDER, -1, -1):
            deep = within[left] >= order
            here, rest = left[deep], left[~deep]
            ctx = contexts[order][here]
            key = ctx << np.int64(8) | data[here].astype(np.int64)
            found, at = self.tables[order][0].find(key)
            bits[here[found]] += self.symbol_bits[order][at[found]]
            lost, lost_ctx = here[~found], ctx[~found]
            known, at = self.tables[order][1].find(lost_ctx)
            bits[lost[known]] += self.escape_bits[order][at[known]]
            left = np.concatenate([rest, lost])
        bits[left] += 8.0
        return np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.float64)


class _Places:
    """Where keys of a sorted array lie, by open addressing: a look-up touches about one place of memory, not one for each halving."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            won = np.flatnonzero(free)[first]
            self.keys[slot[won]], self.at[slot[won]] = keys[left[won]], left[won]
            lost = np.ones(len(left), dtype=bool)
            lost[won] = False
            left, slot = left[lost], (slot[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its place in the sorted array if so."""
        slot = self._slot(wanted)
        there = self.keys[slot]
        found = there == wanted
        left = np.flatnonzero(~found & (there >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & self.mask
            there = self.keys[slot[left]]
            hit = there == wanted[left]
            found[left[hit]] = True
            left = left[~hit & (there >= 0)]
        return found, self.at[slot]


def fit_languages(rows: DataFrame, text: str, label: str, sample_rows: int = 15_000, rounds: int = 2) -> ContextTrees:
    """Trees from the lines of at most `sample_rows` different labelled texts, those of the least hashes.

    The fit alone is bounded; scoring reads every row. Hashes fall into 16 buckets for each row of the sample and every bucket gives its least one, so the
    sample is as large whatever the size of the corpus, neither copies nor frequent texts make it smaller, and what is aggregated is bounded. Labels are
    partly wrong: the most frequent one speaks for a text, and after each round only lines whose label the
    trees confirm stay. Texts without label, and lines with fewer than three words, take no part. Without labelled
    lines there are no languages and every text stays undecided.
    """
    hashed = rows.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("t"), F.col(label).alias("l"))
    least = hashed.groupBy(F.pmod("h", F.lit(16 * sample_rows)).alias("bucket")).agg(F.min("h").alias("h"))
    least = least.orderBy(F.xxhash64("h"), "h").limit(sample_rows).select("h")
    # by the text alone, so that all labels a text was given come together
    spoken = hashed.join(F.broadcast(least), "h").groupBy("t", "l").count().groupBy("t").agg(F.min_by("l", F.struct(-F.col("count"), F.col("l"))).alias("l"))
    lines = spoken.select(F.explode(F.split("t", LINE_BREAK)).alias("t"), "l").filter(F.col("t").rlike(r"\S\s+\S+\s+\S"))
    got = lines.toPandas().drop_duplicates().sort_values(["t", "l"])
    texts, labels = [letters_only(t) for t in got["t"]], list(got["l"])
    if not texts:
        return ContextTrees([], [], [], [], [])
    known = sorted(set(labels))
    half = np.random.default_rng(7).permutation(len(texts)) % 2
    sure = np.ones(len(texts), dtype=bool)
    for _ in range(rounds):
        # each half is judged by trees of the other, so that no line vouches for its own label
        judged = np.zeros(len(texts), dtype=bool)
        for side in (0, 1):
            fit_on = [i for i in np.flatnonzero((half != side) & sure)]
            other = np.flatnonzero(half == side)
            if not fit_on or not len(other):
                judged[other] = True
                continue
            trees = ContextTrees.fit([texts[i] for i in fit_on], [labels[i] for i in fit_on])
            best = trees.code_lengths([texts[i] for i in other]).argmin(axis=1)
            judged[other] = [trees.languages[b] == labels[i] for i, b in zip(other, best, strict=True)]
        sure = judged
    kept = [i for i in range(len(texts)) if sure[i]]
    missing = [i for i in range(len(texts)) if labels[i] in set(known) - {labels[j] for j in kept}]
    return ContextTrees.fit([texts[i] for i in kept + missing], [labels[i] for i in kept + missing])


def score_texts(trees: ContextTrees, texts: list[str]) -> list[tuple[str | None, float | None]]:
    """Language and confidence: the posterior under equal priors; (None, None) for a text without letters."""
    plain = [letters_only(t) for t in texts]
    if not trees.languages:
        return [(None, None)] * len(texts)
    bits = trees.code_lengths(plain)
    best = bits.argmin(axis=1)
    # neighbouring bytes tell much the same, so their bits count for a part only
    weight = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -4000) / DEPENDENCE)
    sure = 1 / weight.sum(axis=1)
    return [(trees.languages[b], float(s)) if p else (None, None) for p, b, s in zip(plain, best, sure, strict=True)]


def detect(rows: DataFrame, text: str, trees: ContextTrees) -> DataFrame:
    """`rows` with `detected` and `confidence`; null, blank and letterless texts stay undecided."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)  # bounded by the fitting sample

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, known = shared.value, {}
        for values in batches:
            codes, distinct = pd.factorize(values)
            if len(known) > KNOWN:
                known.clear()
            new = [t for t in distinct if t not in known]
            known.update(zip(new, score_texts(model, new), strict=True))
            scored = [known[t] for t in distinct]
            yield pd.DataFrame([scored[c] if c >= 0 else (None, None) for c in codes], columns=["detected", "confidence"])

    udf = F.pandas_udf(score, "detected STRING, confidence DOUBLE")
    return rows.withColumn("_scored", udf(F.col(text))).select(*[c for c in rows.columns if c not in ("detected", "confidence")], "_scored.detected", "_scored.confidence")


def message_lines(rows: DataFrame, text: str = "message") -> DataFrame:
    """One row per line: all columns but the text, `line_no` from 1, `line`, `n_words`. A null text has no lines."""
    cut = rows.select(*[c for c in rows.columns if c != text], F.posexplode(F.split(text, LINE_BREAK)).alias("line_no", "line"))
    words = F.size(F.filter(F.split("line", WORD_GAP), lambda w: w != ""))
    return cut.withColumns({"line_no": F.col("line_no").cast("bigint") + 1, "n_words": words})


def lines_to_score(messages: DataFrame, least_words: int = 5) -> DataFrame:
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    kept = messages.filter(off("is_system") & off("is_media") & off("is_deleted")).select("row_id", "lang", "message")
    return message_lines(kept).filter(F.col("n_words") >= least_words)

