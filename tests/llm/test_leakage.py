import random

import numpy as np

from chatloom.llm.leakage import align, align_many, find_leaks, leaks, words_of


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def brute_run(a, b):
    return max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, min(len(a) - i, len(b) - j) + 1) if list(a[i : i + k]) == list(b[j : j + k])), default=0)


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 15)), rng.integers(0, 4, rng.integers(1, 12))
        assert align(a, b) == (brute_align(a, b), brute_run(a, b))
    pairs = [(rng.integers(0, 4, rng.integers(0, 15)), rng.integers(0, 4, rng.integers(1, 12))) for _ in range(40)]
    best, longest = align_many(pairs)
    assert [*zip(best, longest, strict=True)] == [(brute_align(a, b), brute_run(a, b)) for a, b in pairs]


def test_leaks(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 13, 30, 60])))) for i in range(20)]
    docs, want = [], set()
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(0, 80))
        item, text = rng.choice(items)
        part = text.split()
        n = rng.choice([0, 8, 12, 13, 20])
        if len(part) >= n and n:
            at = rng.randrange(len(part) - n + 1)
            words[len(words) // 2 : len(words) // 2] = part[at : at + n]
        docs.append((d, (", \n" if d % 3 else " ").join(w.upper() if d % 2 else w for w in words)))
    docs += [(500, None), (501, ""), (502, docs[0][1])]
    for d, text in docs:
        flat = (text or "").replace(",", " ").lower().split()
        for i, item in items:
            part = item.split()
            if any(flat[a : a + 13] == part[b : b + 13] for a in range(len(flat) - 12) for b in range(len(part) - 12)):
                want.add((d, i))
    D = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").selectExpr("*", "1 AS item_id", "2 AS words")
    I = spark.createDataFrame([*items, (99, None)], "item_id BIGINT, text STRING")
    got = find_leaks(D, I)
    assert {(r["doc_id"], r["item_id"]) for r in got.filter("run >= 13").collect()} == want and want
    blocks = find_leaks(D, I, block_grams=50)
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, got.collect()))
    assert find_leaks(D.limit(0), I).count() == 0 and find_leaks(D, I.limit(0)).count() == 0


def test_edited_copy_scores_high(spark):
    item = " ".join(f"a{i}" for i in range(30))
    words = item.split()
    words[10], words[20] = "other", "word"
    docs = spark.createDataFrame([(1, "x y z " + " ".join(words))], "doc_id BIGINT, text STRING")
    row = find_leaks(docs, spark.createDataFrame([(7, item)], "item_id BIGINT, text STRING")).first()
    assert row["run"] == 10 and row["score"] > 0.85


def test_recall_of_edited_copies(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(30, 60)))) for i in range(60)]
    docs, planted = [], {}
    for d in range(400):
        words = rng.choices(vocabulary, k=80)
        if d % 2:
            i, text = rng.choice(items)
            share = rng.choice([0.05, 0.1, 0.15])
            # words replaced, dropped or put in
            copy = [x for w in text.split() for x in ([w] if rng.random() > share else rng.choice([[rng.choice(vocabulary)], [], [w, rng.choice(vocabulary)]]))]
            words[40:40] = copy
            planted[d] = (i, share)
        docs.append((d, " ".join(words)))
    found = leaks(find_leaks(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), spark.createDataFrame(items, "item_id BIGINT, text STRING")))
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    for share, least in ((0.05, 0.99), (0.1, 0.95), (0.15, 0.8)):
        mine = [(d, i) for d, (i, s) in planted.items() if s == share]
        assert sum(p in got for p in mine) / len(mine) >= least
    assert all(d in planted and planted[d][0] == i for d, i in got)


def test_words_that_only_look_alike():
    assert words_of("А man’s ＣＡＴ—it re\u200bads") == ["a", "man", "s", "cat", "it", "reads"]
    assert words_of(None) == words_of("") == words_of("… !") == []
