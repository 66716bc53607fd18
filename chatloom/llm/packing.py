"""Filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

Method: optimal length buckets. Dynamic programming over the global histogram of lengths chooses the bucket
boundaries that minimise padding; token-budget batches form inside each bucket: a batch is a container with as many slots of the bucket's boundary as fit
the budget. The room that a batch leaves is a budget for the buckets below, the largest first; `mix=False` leaves it empty. Only the histogram and the plan, both bounded by
the capacity, pass through the driver; items find their container by their rank in their bucket, an equi-join.

A text is split only if it alone exceeds the capacity: into full containers and one remainder, which is packed.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.session import checked_broadcast

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Rows of a bucket that are numbered in one task at most, roughly; the fullest bucket sets the number of salts.
GROUP_ROWS = 1_000_000
#: How the byte-level vocabulary cuts a text before merging; fixed with the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """`docs` with `n_tokens`; 0 for null and empty texts. The tokenizer's file goes with the job, from the driver to the executors."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(SparkFiles.get(name))
        for values in batches:
            yield values.map(lambda t: len(encoder.encode_ordinary(t)) if t else 0).astype("int64")

    return docs.withColumn("n_tokens", F.pandas_udf(count, "bigint")(F.coalesce(F.col(text), F.lit(""))))


def bucket_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets with the least total padding, by dynamic programming.

    `lengths` ascending and distinct with their `counts`. The last bound is the largest length.
    """
    n = len(lengths)
    if n <= buckets:
        return [int(x) for x in lengths]
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    t = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.float64)
    upper = lengths.astype(np.float64)
    # padding of a bucket over lengths i..j: bound * count - tokens
    cost = upper * c[1:] - t[1:]
    came = np.zeros((buckets, n), dtype=np.int32)
    for k in range(1, buckets):
        cost, came[k] = _next_bucket(np.concatenate([[0.0], cost]), upper, c, t)
    bounds, j = [], n - 1
    for k in range(buckets - 1, -1, -1):
        bounds.append(int(lengths[j]))
        j = came[k, j] - 1
        if j < 0:
            break
    return sorted(set(bounds))


def _next_bucket(before: np.ndarray, upper: np.ndarray, c: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least costs of lengths 0..j with one bucket more than `before`, and where that bucket begins.

    The best beginning never moves back as j grows, so it is looked for between those of its neighbours, the widest spaced j first: each round
    looks at about 2 n places, all at once.
    """
    n = len(upper)
    best, begins = np.zeros(n), np.zeros(n, dtype=np.int64)
    step = 1 << max(n - 1, 1).bit_length()
    while step >= 1:
        at = np.arange(step - 1, n, 2 * step)
        left, right = at - step, at + step
        lo = np.where(left >= 0, begins[np.maximum(left, 0)], 0)
        hi = np.minimum(np.where(right < n, begins[np.minimum(right, n - 1)], n), at)
        sizes = hi - lo + 1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        which = np.repeat(np.arange(len(at)), sizes)
        i, j = np.arange(sizes.sum()) - starts[which] + lo[which], at[which]
        total = before[i] + upper[j] * (c[j + 1] - c[i]) - (t[j + 1] - t[i])
        least = np.minimum.reduceat(total, starts) if len(at) else total
        first = np.flatnonzero(total == least[which])
        kept = np.unique(which[first], return_index=True)[1]
        best[at], begins[at] = least, i[first[kept]]
        step //= 2
    return best, begins


@dataclass
class Batch:
    """A kind of container: how many slots it has of each bucket, how many there are, where its ranks begin."""

    slots: dict[int, int]
    copies: int


def plan_batches(bounds: list[int], counts: list[int], capacity: int, mix: bool = True) -> list[Batch]:
    """Containers for `counts` items of each bucket, each item taking its bucket's bound, the largest first; without `mix` of one bucket each."""
    left, plan = list(counts), []
    for top in range(len(bounds) - 1, -1, -1):
        while left[top] > 0:
            slots, room = {}, capacity
            for b in range(top, -1 if mix else top - 1, -1):
                fits = min(room // bounds[b], left[b])
                if fits:
                    slots[b] = fits
                    room -= fits * bounds[b]
            copies = min(left[b] // k for b, k in slots.items())
            for b, k in slots.items():
                left[b] -= k * copies
            plan.append(Batch(slots, copies))
    return plan


def pack(docs: DataFrame, capacities: DataFrame, key: str = "doc_id", size: str = "n_tokens", buckets: int = 64, salts: int = 64, mix: bool = True) -> DataFrame:
    """Containers for every row of `capacities` (use_name, capacity_tokens).

    Result: use_name, container, `key`, piece, start_token, n_tokens: one row per document and piece. Documents without tokens need no room and are
    left out, repeated keys are items of their own. `docs` must be stored or cheap, it is read per capacity. Capacities are few and fixed; null or
    non-positive ones are skipped.
    """
    parts = []
    for use in capacities.filter(F.col("capacity_tokens") > 0).orderBy("use_name").collect():
        parts.append(_pack_one(docs.filter(F.col(size) > 0), use["use_name"], use["capacity_tokens"], key, size, buckets, salts, mix))
    if not parts:
        return docs.limit(0).select(F.lit("").alias("use_name"), F.lit(0).cast("bigint").alias("container"), key, F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("start_token"), F.col(size).alias("n_tokens"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _pack_one(docs: DataFrame, use: str, capacity: int, key: str, size: str, buckets: int, salts: int, mix: bool) -> DataFrame:
    spark = docs.sparkSession
    total, room = F.col(size), F.lit(capacity)
    full = F.floor(total / room)
    rest = total - full * room
    whole = docs.filter(full > 0).select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), full - 1)).alias("piece"))
    whole = whole.select(key, F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    items = docs.filter(rest > 0).select(key, full.cast("int").alias("piece"), (full * capacity).alias("start_token"), rest.cast("bigint").alias("n_tokens"))

    per_rest = docs.groupBy(rest.cast("bigint").alias("n_tokens")).agg(F.count("*").alias("count"), F.sum(full).alias("whole")).orderBy("n_tokens").collect()  # at most `capacity` rows
    histogram, n_whole = [r for r in per_rest if r["n_tokens"] > 0], sum(r["whole"] or 0 for r in per_rest)
    lengths, counts = np.array([r[0] for r in histogram], dtype=np.int64), np.array([r[1] for r in histogram], dtype=np.int64)
    bounds = bucket_bounds(lengths, counts, buckets) if len(histogram) else []
    at = np.searchsorted(bounds, lengths) if bounds else np.array([], dtype=int)
    per_bucket = [int(counts[at == b].sum()) for b in range(len(bounds))]
    plan = plan_batches(bounds, per_bucket, capacity, mix)
    salts, whole_salts = (max(salts, -(-most // GROUP_ROWS)) for most in (max(per_bucket, default=0), n_whole))

    # container number = first of its kind + place among its copies; place = (rank - first rank of the kind) div slots
    lines, rank_from, container = [], [0] * len(bounds), 0
    for batch in plan:
        for b, slots in batch.slots.items():
            lines.append((b, rank_from[b], rank_from[b] + slots * batch.copies, slots, container))
            rank_from[b] += slots * batch.copies
        container += batch.copies
    kinds = spark.createDataFrame(lines, "bucket INT, lo BIGINT, hi BIGINT, slots BIGINT, first BIGINT") if lines else None

    in_bucket = F.lit(len(bounds) - 1)
    for b in range(len(bounds) - 2, -1, -1):
        in_bucket = F.when(F.col("n_tokens") <= bounds[b], b).otherwise(in_bucket)
    number = Window.partitionBy("salt").orderBy(key, "piece")
    salted = whole.withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(whole_salts)))
    sizes = salted.groupBy("salt").count()
    offsets = sizes.select("salt", (F.sum("count").over(Window.orderBy("salt")) - F.col("count") + container).alias("offset"))
    full_containers = salted.withColumn("n", F.row_number().over(number)).join(checked_broadcast(offsets, whole_salts), "salt").select(key, "piece", "start_token", "n_tokens", (F.col("offset") + F.col("n") - 1).alias("container"))
    if kinds is None:
        out = full_containers
    else:
        salted = items.withColumns({"bucket": in_bucket, "salt": F.pmod(F.xxhash64(key, "piece"), F.lit(salts))})
        # ranks in a bucket by salted counting: no bucket is ever in one task
        sizes = salted.groupBy("bucket", "salt").count()
        before = F.sum("count").over(Window.partitionBy("bucket").orderBy("salt")) - F.col("count")
        offsets = sizes.select("bucket", "salt", before.alias("offset"))  # buckets x salts rows
        ranked = salted.withColumn("n", F.row_number().over(Window.partitionBy("bucket", "salt").orderBy(key, "piece")))
        ranked = ranked.join(checked_broadcast(offsets, len(bounds) * salts), ["bucket", "salt"]).withColumn("rank", F.col("offset") + F.col("n") - 1)
        # the plan has a row per bucket and kind of container, bounded by the buckets
        placed = ranked.join(F.broadcast(kinds), (ranked["bucket"] == kinds["bucket"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        place = F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("slots"))
        out = placed.select(key, "piece", "start_token", "n_tokens", place.alias("container")).unionByName(full_containers)
    return out.select(F.lit(use).alias("use_name"), F.col("container").cast("bigint").alias("container"), key, "piece", "start_token", "n_tokens")


def fill(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Use of the room per capacity: containers, tokens, share of unused room."""
    used = packed.groupBy("use_name").agg(F.count_distinct("container").alias("containers"), F.sum("n_tokens").alias("tokens"))
    room = F.col("containers") * F.col("capacity_tokens")
    return used.join(checked_broadcast(capacities, capacities.count()), "use_name").select("use_name", "capacity_tokens", "containers", "tokens", (1 - F.col("tokens") / room).alias("unused_share"))
