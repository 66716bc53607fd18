"""Evaluation texts leaking into training text.

Method: rare n-gram seeds join the documents to the test items, then a local alignment after Smith and Waterman scores
what lies around the seeds, so edited and paraphrased copies are found as well as exact ones.

Seeds: all n-grams of the test items are counted over the whole corpus; of every window of consecutive words an exact leak
must cover, the rarest n-gram is a seed. So each leak of that length holds at least one seed whatever the counts, while n-grams
that all documents share are seeds only where nothing rarer exists.

Scale: the corpus is read once. The n-grams of the items go to the tasks in blocks of a counted, bounded size (a set of items beyond it makes
more blocks, each a pass); a document without any of them ends in its task, the others are written with their words and hits, and are all that is read
again. Documents are never shuffled: only counts of n-grams are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions.textform import LATIN_LOOKS, normal_form
from chatloom.session import checked_broadcast, materialize

NGRAM = 6
WORDS = 13
#: N-grams of items in a block at most, roughly: what a task holds of them.
BLOCK_GRAMS = 200_000
_WORD = re.compile(r"[^\W_]+")
#: Letters of other scripts as the Latin ones they look like, also where a whole word is written with them: a form for comparing only.
_SKELETON = str.maketrans({k.casefold(): v.casefold() for k, v in reversed(LATIN_LOOKS.items()) if len(k.casefold()) == 1})
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The words of a text in one form: runs of letters and digits. Null and empty texts have none."""
    if not text:
        return []
    return _WORD.findall(text.lower() if text.isascii() else normal_form(text).translate(_SKELETON))


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A key for each run of `n` word ids, -1 where one of them is negative; the last n - 1 places have none."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.int64)
    keys, whole = np.zeros(len(ids) - n + 1, dtype=np.uint64), np.ones(len(ids) - n + 1, dtype=bool)
    for k in range(n):
        part = ids[k : len(ids) - n + 1 + k]
        keys = (keys ^ (part.astype(np.uint64) + np.uint64(1))) * _MIX
        keys ^= keys >> np.uint64(29)
        whole &= part >= 0
    return np.where(whole, (keys >> np.uint64(1)).astype(np.int64), -1)


class Items:
    """Test items of a block: their words as numbers, and the keys of their n-grams in order."""

    def __init__(self, items: dict[int, list[str]], n: int):
        self.n, self.ids = n, {}
        self.words = {key: np.array([self.ids.setdefault(w, len(self.ids)) for w in words], dtype=np.int64) for key, words in items.items()}
        self.grams = {key: gram_keys(w, n) for key, w in self.words.items()}
        self.keys = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *self.grams.values()]))


def rare_seeds(grams: DataFrame, counts: DataFrame, item: str, n: int = NGRAM, words: int = WORDS) -> DataFrame:
    """Seeds (item, item_at, gram) of n-grams (item, item_at, gram): the rarest of each window of `words` words by its count in the corpus.

    An item shorter than the window has one seed, its rarest n-gram; items of fewer than n words have none.
    """
    found = grams.join(counts, "gram", "left")
    # an n-gram that no document holds leads nowhere: it comes last
    never = F.lit(2**62)
    rarity = F.struct(F.coalesce("count", never).alias("count"), F.col("item_at"), F.col("gram"))
    window = Window.partitionBy(item).orderBy("item_at").rowsBetween(0, words - n)
    last = F.max("item_at").over(Window.partitionBy(item))
    whole = F.col("item_at") <= F.greatest(last - (words - n), F.lit(0))
    best = found.select(item, F.min(rarity).over(window).alias("best"), whole.alias("whole")).filter(F.col("whole") & (F.col("best.count") < never))
    return best.select(item, F.col("best.item_at").alias("item_at"), F.col("best.gram").alias("gram")).distinct()


def align_many(pairs: list[tuple[np.ndarray, np.ndarray]], match: int = 2, miss: int = -1, gap: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment scores of pairs of word sequences after Smith and Waterman, and their longest common runs, all pairs a step at a time."""
    n, long, wide = len(pairs), max((len(a) for a, _ in pairs), default=0), max((len(b) for _, b in pairs), default=0)
    a, b = np.full((n, long), -1, dtype=np.int64), np.full((n, wide), -2, dtype=np.int64)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, : len(y)] = x, y
    best, longest = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    above, run_above = np.zeros((n, wide + 1), dtype=np.int32), np.zeros((n, wide + 1), dtype=np.int32)
    steps = np.arange(wide + 1, dtype=np.int32) * -gap
    for i in range(long):
        same = b == a[:, i : i + 1]
        run, row = np.zeros_like(run_above), np.zeros_like(above)
        run[:, 1:] = np.where(same, run_above[:, :-1] + 1, 0)
        row[:, 1:] = np.maximum(0, np.maximum(above[:, :-1] + np.where(same, match, miss), above[:, 1:] + gap))
        # gaps along the row: the best earlier cell less one gap a step
        row = np.maximum(row, np.maximum.accumulate(row + steps, axis=1) - steps)
        # past its end a pair of sequences has nothing that counts
        best, longest = np.maximum(best, row.max(axis=1)), np.maximum(longest, run.max(axis=1))
        above, run_above = row, run
    return best, longest


def align(a: np.ndarray, b: np.ndarray, match: int = 2, miss: int = -1, gap: int = -1) -> tuple[int, int]:
    """`align_many` of one pair."""
    best, longest = align_many([(a, b)], match, miss, gap)
    return int(best[0]), int(longest[0])


def find_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", n: int = NGRAM, words: int = WORDS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Pairs of document and item that share a seed: `doc`, `item`, `points` of their alignment, `score` (the share of what the item could reach),
    `run` (most consecutive words in common).

    Every pair with `words` consecutive words in common is among them, with its exact `run`; an edited copy has a lower run and high points. Null texts
    take no part; documents that come twice come out twice; an item id that comes twice stands for all its texts in turn. Alignment covers the part of the document around
    its seeds, wide enough for the whole item on both sides of each.
    """
    given = items.filter(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item), F.col(text))
    # an upper bound of the number of n-grams, which needs no words
    blocks = max(1, -(-(given.agg(F.sum(F.length(text))).first()[0] or 0) // (2 * block_grams)))
    out = None
    for block in range(blocks):
        mine = given.filter(F.pmod(F.xxhash64(item, text), F.lit(blocks)) == block)
        found = _find_in_block(documents.select(F.col(doc), F.col(text)), mine, doc, item, text, n, words)
        out = found if out is None else out.unionByName(found)
    return out


def _find_in_block(documents: DataFrame, items: DataFrame, doc: str, item: str, text: str, n: int, words: int) -> DataFrame:
    spark = documents.sparkSession
    rows = items.collect()  # one block, bounded
    block = Items({i: words_of(r[text]) for i, r in enumerate(rows)}, n)
    shared = spark.sparkContext.broadcast(block)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            of_doc = [words_of(t) for t in batch[text]]
            lengths = np.fromiter((len(w) + 1 for w in of_doc), dtype=np.int64, count=len(of_doc))
            ids = np.fromiter((i for w in of_doc for i in (*map(known.ids.get, w, repeat(-1)), -1)), dtype=np.int64, count=int(lengths.sum()))
            keys = gram_keys(ids, known.n)
            at = np.flatnonzero(keys >= 0)
            at = at[np.isin(keys[at], known.keys)]
            ends = np.cumsum(lengths)
            holder = np.searchsorted(ends, at, side="right")
            out = []
            for d in np.unique(holder):
                mine = at[holder == d]
                out.append((batch[doc].iloc[d], of_doc[d], keys[mine], (mine - (ends[d] - lengths[d])).astype(np.int32)))
            yield pd.DataFrame(out, columns=[doc, "words", "grams", "ats"])

    id_type, item_type = documents.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()
    hits = documents.filter(F.col(text).isNotNull()).mapInPandas(scan, f"{doc} {id_type}, words ARRAY<STRING>, grams ARRAY<BIGINT>, ats ARRAY<INT>")
    hits = materialize(hits, "hits")
    counts = hits.select(F.explode("grams").alias("gram")).groupBy("gram").count()
    grams = spark.createDataFrame([(i, at, int(g)) for i, keys in block.grams.items() for at, g in enumerate(keys)], "item BIGINT, item_at INT, gram BIGINT")
    n_grams = sum(map(len, block.grams.values()))
    seeds = rare_seeds(grams, checked_broadcast(counts, n_grams), "item", n, words).collect()  # at most the block's n-grams
    places: dict[int, list[tuple[int, int]]] = {}
    for s in seeds:
        places.setdefault(s["gram"], []).append((s["item"], s["item_at"]))
    ids = [r[item] for r in rows]
    seeded = spark.sparkContext.broadcast((places, ids))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, (at_items, item_ids) = shared.value, seeded.value
        for batch in batches:
            pairs, jobs = [], []
            for d, there, keys, ats in zip(batch[doc], batch["words"], batch["grams"], batch["ats"], strict=True):
                found: dict[int, list[tuple[int, int]]] = {}
                for key, at in zip(keys, ats, strict=True):
                    for i, item_at in at_items.get(key, ()):
                        found.setdefault(i, []).append((int(at), item_at))
                numbers = np.fromiter(map(known.ids.get, there, repeat(-1)), dtype=np.int64, count=len(there)) if found else None
                for i, places_there in found.items():
                    wanted = known.words[i]
                    for lo, hi in _windows(places_there, len(wanted), len(there)):
                        jobs.append((len(pairs), numbers[lo:hi], wanted))
                    pairs.append((d, item_ids[i], len(wanted)))
            points, runs = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
            # those of like length together, so that little is aligned for nothing
            jobs.sort(key=lambda j: (len(j[1]), len(j[2])))
            for k in range(0, len(jobs), 128):
                part = jobs[k : k + 128]
                best, longest = align_many([(a, b) for _, a, b in part])
                of = np.array([p for p, _, _ in part])
                np.maximum.at(points, of, best)
                np.maximum.at(runs, of, longest)
            size = np.array([p[2] for p in pairs], dtype=np.float64)
            yield pd.DataFrame({doc: [p[0] for p in pairs], item: [p[1] for p in pairs], "points": points, "score": points / (2.0 * size), "run": runs})

    return hits.mapInPandas(score, f"{doc} {id_type}, {item} {item_type}, points BIGINT, score DOUBLE, run INT")


def leaks(found: DataFrame, words: int = WORDS) -> DataFrame:
    """The pairs of `find_leaks` that are leaks: aligned at least as well as `words` consecutive words, `exact` where so many stand there unchanged, else `edited`."""
    return found.filter(F.col("points") >= 2 * words).withColumn("kind", F.when(F.col("run") >= words, "exact").otherwise("edited"))


def _windows(seeds: list[tuple[int, int]], length: int, total: int) -> list[tuple[int, int]]:
    """Parts of a document around its seeds, each wide enough for the whole item, overlapping ones as one."""
    out: list[list[int]] = []
    # in order of their lower bounds, which isn't that of the seeds
    for start in sorted(doc_at - item_at for doc_at, item_at in seeds):
        lo, hi = max(0, start - 8), min(total, start + length + 8)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]
