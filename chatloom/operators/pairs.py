"""Counting pairs of words in neighbouring messages inside a task.

Pairs are many times as long as the texts they come from, so they are neither shuffled nor kept: a task takes whole groups of texts in order, gives
each word a number and counts the pairs of some words at a time by sorting numbers. What it holds is the texts of its groups and one portion of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs that are counted at a time, rows of a batch that leaves a task, bytes of small groups that are taken together.
PAIRS, ROWS, TOGETHER = 1 << 21, 1 << 15, 1 << 20


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size says."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _turns(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any column, and for the first."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def _array(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _nearby(code: np.ndarray, start: np.ndarray, size: np.ndarray, run: np.ndarray, own: np.ndarray, reach: int, bits: int, pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """The different words within `reach` messages of each message of its own, one list after another, and how many each has."""
    lists, sizes = [np.zeros(0, dtype=np.int32)], np.zeros(len(run), dtype=np.int64)
    before = np.concatenate([[0], np.cumsum(size)])
    low = 0
    while low < len(run):
        # as many messages as have `pairs` words in reach, one at least
        high = max(low + 1, int(np.searchsorted(before, before[low] + pairs // (2 * reach + 1), side="right")) - 1)
        each, keys = np.flatnonzero(own[low:high]) + low, []
        for step in range(-reach, reach + 1):
            at = each[(each + step >= 0) & (each + step < len(run))]
            at = at[run[at + step] == run[at]]
            n = size[at + step]
            keys.append((np.repeat(at - low, n) << bits) | code[_spread(start[at + step], n)])
        found = np.concatenate(keys)
        found.sort()
        found = found[_turns(found)]
        lists.append((found & ((1 << bits) - 1)).astype(np.int32))
        sizes[low:high] = np.bincount(found >> bits, minlength=high - low)
        low = high
    return np.concatenate(lists), sizes


def _pairs(table: pa.Table, reach: int, least: int, pairs: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the groups in `table`, which is in order of chat_id, block, msg_id."""
    table = table.combine_chunks()
    column = {c: table[c].chunk(0) for c in table.column_names}
    own, turned = _array(column["own"]), _turns(_array(column["chat_id"]), _array(column["block"]))
    dates = _array(column["date"].dictionary_encode(null_encoding="encode").indices)
    group, run = np.cumsum(turned) - 1, np.cumsum(turned | _turns(dates))
    lists = pc.split_pattern(column["stems"], " ")
    words, message = pc.list_flatten(lists).dictionary_encode(), _array(pc.list_parent_indices(lists)).astype(np.int64)
    vocabulary, code = words.dictionary, _array(words.indices).astype(np.int64)
    # a text without words splits into one that is empty
    some = code != pc.index(vocabulary, pa.scalar("")).as_py()
    del lists, words, column["stems"], table
    code, message, bits = code[some], message[some], max(1, len(vocabulary).bit_length())
    size = np.bincount(message, minlength=len(own))
    near, n_near = _nearby(code, np.cumsum(size) - size, size, run, own, reach, bits, pairs)
    near_start = np.cumsum(n_near) - n_near

    # the occurrences of each word of a group, one word after another
    mine = own[message]
    key, message = (group[message[mine]] << bits) | code[mine], message[mine]
    order = np.argsort(key, kind="stable")
    key, message = key[order], message[order]
    first = np.flatnonzero(_turns(key)) if len(key) else np.zeros(0, dtype=np.int64)
    word, chat = key[first] & ((1 << bits) - 1), column["chat_id"].take(pa.array(np.flatnonzero(turned)[key[first] >> bits]))
    first, work = np.append(first, len(key)), np.concatenate([[0], np.cumsum(n_near[message])])
    upto = work[first]
    low = 0
    while low < len(word):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + pairs, side="right")) - 1)
        if upto[high] - upto[low] > pairs:
            # one word with more pairs than are held at a time
            counts, at = np.zeros(len(vocabulary), dtype=np.int64), int(first[low])
            while at < first[high]:
                end = min(max(at + 1, int(np.searchsorted(work, work[at] + pairs, side="right")) - 1), int(first[high]))
                counts += np.bincount(near[_spread(near_start[message[at:end]], n_near[message[at:end]])], minlength=len(vocabulary))
                at = end
            other = np.flatnonzero(counts)
            which, n = np.zeros(len(other), dtype=np.int64), counts[other]
        else:
            at, kind = message[first[low] : first[high]], np.int32 if (high - low) << bits < 1 << 31 else np.int64
            which = np.repeat(np.arange(high - low, dtype=kind) << bits, np.diff(first[low : high + 1]))
            found = np.repeat(which, n_near[at]) | near[_spread(near_start[at], n_near[at])]
            found.sort()
            ends = np.flatnonzero(_turns(found)) if len(found) else np.zeros(0, dtype=np.int64)
            n, found = np.diff(np.append(ends, len(found))), found[ends]
            which, other = found >> bits, found & ((1 << bits) - 1)
        kept = (other != word[low + which]) & (n >= least)
        which, other, n = low + which[kept], other[kept], n[kept]
        for at in range(0, len(n), ROWS):
            a, b = which[at : at + ROWS], other[at : at + ROWS]
            columns = [chat.take(pa.array(a)), vocabulary.take(pa.array(word[a])), vocabulary.take(pa.array(b)), pa.array(n[at : at + ROWS])]
            yield pa.RecordBatch.from_arrays(columns, names=["chat_id", "a", "b", "n"])
        low = high


def count_pairs(batches: Iterator[pa.RecordBatch], reach: int, least: int, pairs: int = PAIRS, together: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Rows (chat_id, block, msg_id, own, date, stems) in this order, groups of (chat_id, block) whole, to rows (chat_id, a, b, n): for each occurrence
    of a word in a row of its own, 1 per other word within `reach` rows of one run of a date; pairs that come less than `least` times left out."""
    ready, unfinished, last = [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        chat, block = _array(batch["chat_id"]), _array(batch["block"])
        if last != (chat[0], block[0]):
            ready, unfinished = ready + unfinished, []
        cut = int(np.flatnonzero(_turns(chat, block))[-1])
        if cut:
            ready, unfinished = [*ready, *unfinished, batch.slice(0, cut)], []
        unfinished.append(batch.slice(cut))
        last = (chat[-1], block[-1])
        if sum(b.nbytes for b in ready) >= together:
            yield from _pairs(pa.Table.from_batches(ready), reach, least, pairs)
            ready = []
    if ready or unfinished:
        yield from _pairs(pa.Table.from_batches(ready + unfinished), reach, least, pairs)
