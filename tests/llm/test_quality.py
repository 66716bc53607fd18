import random

import numpy as np

from chatloom.llm import labelled
from chatloom.llm.quality import STATISTICS, classify, fit_rules, induce_rules, judge, learned_rules, statistics, to_case

PROSE = ["We should meet near the old mill before it starts, what do you think?", "I left the keys at home. It was late and we had to wait.", "Ana: I am on my way\nBob: will you be there before six?"]
LISTS = ["- milk\n- rice\n- two towels\n- soap", "1. milk\n2. rice\n3. soap\n4. rope", "milk\nrice\ntwo towels\nsoap\nrope"]
TABLES = ["name;n;m\nAna;12;344\nBob;9;1200", "a\t12\t44\nb\t9\t120\nc\t88\t3", "| a | b |\n| --- | --- |\n| 12 | 44 |\n| 13 | 88 |"]
JUNK = ["lol lol lol lol lol lol lol lol lol", "==========\n..........", "QmFzZTY0IGlzIG5vdCBhIHRleHQgYXQgYWxsLCBpdCBpcyBub2lzZQ/x+9a8"]


def test_statistics(spark):
    df = spark.createDataFrame([(1, "One two.\nthree"), (2, None), (3, "  "), (4, "word " * 50_000)], "doc_id INT, text STRING").selectExpr("*", "'x' AS n_words")
    got = {r["doc_id"]: r for r in statistics(df).collect()}
    assert got[1]["n_words"] == 3 and got[1]["n_lines"] == 2 and got[1]["end_mark_share"] == 0.5
    assert got[2]["n_words"] == got[3]["n_words"] == 0 and got[4]["n_words"] == 50_000 and got[4]["repeat_share"] > 0.99
    assert statistics(df.limit(0)).count() == 0


SENTENCES = [
    "did anyone see the {} near the {}? I have looked everywhere", "it took me two hours to find the {}, never again", "could you bring the {} when you come to the {}",
    "please do not forget the {} before you leave the {}.", "we walked by the {} and talked about the {} until it got dark", "ok, see you at the {} then", "nobody told me that the {} was moved to another day 🌧️",
    "mañana vamos a comprar el {} para la {} y después hablamos", "das {} war viel schöner als gedacht, ich komme gern mit {}", "honestly the {} was much better than I expected it to be",
]
THINGS = "lantern garden ladder kettle harbour ticket bicycle picnic library blanket curtain market suitcase orchard pottery umbrella".split()


def messages(seed, n=400):
    rng = random.Random(seed)
    said = [(rng.choice("Ana Bruno Clara Dev".split()) + " X", rng.choice(SENTENCES).format(*rng.sample(THINGS, 2))) for _ in range(n)]
    return [{"sender": who, "lang": "en", "message": m, "number": i} for i, (who, m) in enumerate(said)]


def test_held_out_accuracy(spark):
    made = lambda seed, n: spark.createDataFrame(labelled.labelled_documents(messages(seed), n, seed), "text STRING, kind STRING")
    rules = fit_rules(statistics(made(1, 2000)))
    # documents made from other messages, and texts written by hand
    other = classify(statistics(made(2, 700).withColumnRenamed("kind", "want")), rules).collect()
    assert sum(r["kind"] == r["want"] for r in other) / len(other) > 0.95
    kinds = {"prose": PROSE, "list": LISTS, "table": TABLES, "junk": JUNK}
    assert [r["kind"] for r in judge(made(3, 200).select("text"), rules).collect()] == [r["kind"] for r in classify(statistics(made(3, 200).select("text")), rules).collect()]
    by_hand = spark.createDataFrame([(t, k) for k, texts in kinds.items() for t in texts], "text STRING, want STRING")
    assert sum(r["kind"] == r["want"] for r in classify(statistics(by_hand), rules).collect()) >= 10


def test_sample_is_bounded_and_holds_no_copies(spark):
    rows = [(i, 1, i, "Ana", "en", f"message number {i % 500}", False, False, False) for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id BIGINT, chat_id BIGINT, msg_id BIGINT, sender STRING, lang STRING, message STRING, is_system BOOLEAN, is_media BOOLEAN, is_deleted BOOLEAN")
    got = [r["message"] for r in labelled.sample_messages(df, 100)]
    assert len(got) == len(set(got)) == 100
    assert len(labelled.sample_messages(df, 1000)) > 450
    assert labelled.sample_messages(df.limit(0), 100) == [] and learned_rules(df.limit(0)) == []


def test_rules_are_ordered_and_exported():
    rng = np.random.default_rng(0)
    x = rng.random((600, len(STATISTICS)))
    kinds = np.where(x[:, 0] > 0.7, "table", np.where(x[:, 3] < 0.2, "list", "prose"))
    rules = induce_rules(x, kinds)
    got = np.full(len(x), "prose", dtype=object)
    done = np.zeros(len(x), dtype=bool)
    for r in rules:
        hit = r.on(x) & ~done
        got[hit], done = r.kind, done | hit
    assert (got == kinds).mean() > 0.97
    assert to_case([]) == "'prose'" and to_case(rules).count("WHEN") == len(rules)
