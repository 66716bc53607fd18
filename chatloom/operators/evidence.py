"""Evidence for a question in all chats at once: candidates, scores, passes, confidence and context, as columns and joins over a stored index.

The index is one row per message with its tokens; a question is a handful of words, so every part of the score is an expression over that row and over a small
row of its chat (frequencies of the question's words, the person asked about, related stems). One reading of the index scores all passes; only messages
with a score are written and ranked. What is joined per chat is broadcast after its chats are counted; positions next to an anchor come by equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import chattext as ct
from chatloom.operators.adjacent import running_count, with_previous
from chatloom.operators.questions import FILLERS, PRONOUNS, Question
from chatloom.operators.report import top
from chatloom.operators.retrieval import B, K1
from chatloom.session import checked_broadcast, materialize, settled

# What each part of a score is worth.
PHRASE, LONG_PHRASE, TOPIC, OTHER, TOPIC_STEM, OTHER_STEM, CONCEPT, FUZZY, SEMANTIC = 32.0, 48.0, 14.0, 1.5, 10.0, 1.0, 16.0, 14.0, 40.0
PARTS = ["phrase", "bm25", "stem", "concept", "sender", "proximity", "fuzzy", "semantic", "many"]


def index(m: DataFrame) -> DataFrame:
    """The stored index of messages (chat_id, msg_id, date, sender, message): `at` counts from 0 in each chat, `run` numbers stretches of one date."""
    base = with_previous(m.select("chat_id", "msg_id", "date", "sender", "message"), "chat_id", "msg_id", ["date"])
    base = base.withColumns({"one": F.lit(True), "turned": F.col("prev").isNull() | ~F.col("prev.date").eqNullSafe(F.col("date"))}).drop("prev")
    placed = running_count(running_count(base, "chat_id", "msg_id", "one", "nth"), "chat_id", "msg_id", "turned", "run")
    # step by step, so that no text is brought into its form twice
    text = settled(placed.drop("one", "turned"), {"normal": ct.normal_chat(F.col("message"))})
    text = settled(text, {"said": ct.tokens_of(F.col("normal")), "normal": F.lower("normal")})
    text = settled(text, {"tokens": ct.meaningful_of(F.col("said")), "asks": ct.asks_of(F.col("message"), F.col("said")), "answers": ct.short_answer_of(F.col("said"))})
    columns = {"stems": F.transform("tokens", lambda t: ct.stem(t)), "who": F.lower(ct.normal_chat(F.regexp_replace("sender", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))), "quality": ct.quality(F.col("message"))}
    out = text.withColumns(columns).withColumn("at", F.col("nth") - 1).drop("nth")
    return materialize(out.repartition("chat_id", F.floor(F.col("at") / 65_536)).sortWithinPartitions("chat_id", "at"), "index")


def sender_postings(docs: DataFrame) -> DataFrame:
    """Under which names a sender's messages are found: the whole name and its parts of two letters or more; chat_id, name, messages."""
    parts = F.filter(F.split("who", r"\s+"), lambda p: (F.char_length(p) >= 2) & (p != F.col("who")))
    named = docs.groupBy("chat_id", "who").agg(F.count("*").alias("n")).filter("who <> ''")
    return named.select("chat_id", F.explode(F.concat(F.array("who"), parts)).alias("name"), "n").groupBy("chat_id", "name").agg(F.sum("n").alias("messages"))


def people_asked(docs: DataFrame, q: Question) -> DataFrame:
    """Senders that a question names, wholly or by a part of three letters or more: chat_id, `who`, `first`, the place of their first message."""
    parts = F.filter(F.split("who", r"\s+"), lambda p: F.char_length(p) >= 3)
    known = F.arrays_overlap(parts, F.array(*[F.lit(w) for w in q.words])) if q.words else F.lit(False)
    return docs.groupBy("chat_id", "who").agg(F.min("at").alias("first")).filter((F.col("who") != "") & (F.lit(q.normal).contains(F.col("who")) | known))


def related_stems(docs: DataFrame, stems: list[str], reach: int = 2, k: int = 6) -> DataFrame:
    """Stems said near those of a question: chat_id, stem, related, n, weight; the `k` most frequent of each.

    Near is within `reach` messages of one stretch of a date. Such a stem stands there twice or more, in three of ten of the rarer one's places, and in less than two fifths of all messages.
    """
    base = [s for s in stems if s not in ct.INTERROGATIVES and s not in PRONOUNS and s not in FILLERS]
    holds = docs.filter(F.arrays_overlap("stems", F.array(*[F.lit(s) for s in base]).cast("array<string>")))
    sent = holds.select("chat_id", "run", F.col("at").alias("from"), "stems", F.explode(F.sequence(F.col("at") - reach, F.col("at") + reach)).alias("at"))
    near = sent.join(docs.select("chat_id", "run", "at", F.col("stems").alias("other")), ["chat_id", "run", "at"])
    around = near.groupBy("chat_id", "from").agg(F.any_value("stems").alias("stems"), F.array_distinct(F.flatten(F.collect_list("other"))).alias("other"))
    pairs = around.select("chat_id", F.explode(F.filter("stems", lambda s: s.isin(*base))).alias("stem"), "other").select("chat_id", "stem", F.explode("other").alias("related"))
    dull = sorted({*ct.INTERROGATIVES, *PRONOUNS, *FILLERS, *ct.LIGHT_STOP_WORDS, *stems})
    counted = pairs.filter(~F.col("related").isin(*dull) & (F.char_length("related") >= 3)).groupBy("chat_id", "stem", "related").agg(F.count("*").alias("n")).filter("n >= 2")
    said = docs.select("chat_id", F.explode("stems").alias("s")).groupBy("chat_id", "s").agg(F.count("*").alias("said"))
    held = docs.select("chat_id", F.explode(F.array_distinct("tokens")).alias("s")).groupBy("chat_id", "s").agg(F.count("*").alias("held"))
    size = docs.groupBy("chat_id").agg(F.count("*").alias("docs"))
    both = counted.join(said.withColumnsRenamed({"s": "related", "said": "b"}), ["chat_id", "related"]).join(said.withColumnsRenamed({"s": "stem", "said": "a"}), ["chat_id", "stem"])
    both = both.join(held.withColumnRenamed("s", "related"), ["chat_id", "related"], "left").join(size, "chat_id")
    close = both.filter((F.col("n") / F.least("a", "b") >= 0.3) & (F.coalesce("held", F.lit(0)) < F.col("docs") * 0.4))
    kept = top(close, ["chat_id", "stem"], [F.desc("n"), F.col("related")], k)
    return kept.select("chat_id", "stem", "related", "n", F.least(F.lit(0.65), 0.2 + F.col("n") * 0.08).alias("weight"))


def _of_chat(docs: DataFrame, q: Question, learned: DataFrame | None) -> DataFrame:
    """One small row per chat: size, mean length, frequencies of the question's words, the people asked about, related stems."""
    words = sorted({*q.words, *q.stems})
    size = docs.groupBy("chat_id").agg(F.count("*").alias("_docs"), F.greatest(F.avg(F.size("tokens")), F.lit(1.0)).alias("_average"))
    mapped = lambda df, key, value, name: df.groupBy("chat_id").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))
    asked = docs.select("chat_id", F.explode(F.filter(F.array_distinct("tokens"), lambda t: t.isin(*words) if words else F.lit(False))).alias("token"))
    held = mapped(asked.groupBy("chat_id", "token").agg(F.count("*").alias("n")), "token", "n", "_df")
    people = materialize(people_asked(docs, q), "people")
    target = people.groupBy("chat_id").agg(F.min_by("who", "first").alias("_target"))
    # of each person the first hundred messages are candidates
    hundred = top(docs.select("chat_id", "who", "at").join(people.select("chat_id", "who"), ["chat_id", "who"], "left_semi"), ["chat_id", "who"], [F.col("at")], 100)
    until = mapped(hundred.groupBy("chat_id", "who").agg(F.max("at").alias("at")), "who", "at", "_until")
    concepts = related_stems(docs, q.topic_stems or q.stems).select("chat_id", "related", "weight")
    if learned is not None:
        told = learned.filter(F.col("stem").isin(*q.topic_stems) & (F.col("weight") >= 0.4) & ~F.col("related").isin(*words)) if q.topic_stems else learned.limit(0)
        concepts = concepts.unionByName(told.select("chat_id", "related", F.least(F.lit(0.9), F.col("weight") * 0.55).alias("weight")))
    concepts = mapped(concepts.groupBy("chat_id", "related").agg(F.max("weight").alias("weight")), "related", "weight", "_concepts")
    out = size
    for part in (held, target, until, concepts):
        out = out.join(part, "chat_id", "left")
    return out


def _bm25(tf: Column, df: Column) -> Column:
    idf = F.ln((F.col("_docs") - df + 0.5) / (df + 0.5) + 1)
    return F.greatest(F.lit(0.0), idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.greatest(F.size("tokens"), F.lit(1)) / F.col("_average"))))


def _times(words: str, word: str) -> Column:
    return F.size(F.filter(words, lambda t: t == word))


def _sum(parts) -> Column:
    return sum(parts, F.lit(0.0))


def counted(docs: DataFrame, q: Question) -> DataFrame:
    """`docs` with how often each word and each stem of the question stands there, in arrays `_tf` and `_stf`, which `lexical` reads."""
    times = lambda column, words: F.array(*[_times(column, w) for w in words]).cast("array<int>")
    return settled(docs, {"_tf": times("tokens", q.words), "_stf": times("stems", q.stems)})


def lexical(q: Question) -> dict[str, Column]:
    """The parts of a score that a message (see `counted`) and the frequencies of its chat give: phrase, bm25, stem, proximity, many, and how many words match."""
    tf = {w: F.col("_tf")[i] for i, w in enumerate(q.words)}
    stf = {s: F.col("_stf")[i] for i, s in enumerate(q.stems)}
    df = lambda w: F.coalesce(F.try_element_at("_df", F.lit(w)), F.lit(1))
    places = F.filter(F.array(*[F.array_position("tokens", w) for w in q.words]).cast("array<bigint>"), lambda p: p > 0)
    span = F.array_max(places) - F.array_min(places) + 1
    near = F.when(span <= 4, 22.0).when(span <= 8, 14.0).when(span <= 14, 6.0).otherwise(0.0)
    direct = _sum(F.when(n > 0, 1).otherwise(0) for n in tf.values())
    return {
        "direct": direct,
        "direct_topic": _sum(F.when(tf[w] > 0, 1).otherwise(0) for w in q.words if w in q.topic),
        "phrase": _sum(F.when(F.col("normal").contains(p), LONG_PHRASE if len(p.split(" ")) >= 3 else PHRASE).otherwise(0.0) for p in q.phrases),
        "bm25": _sum(F.when(n > 0, _bm25(n, df(w)) * (TOPIC if w in q.topic else OTHER)).otherwise(0.0) for w, n in tf.items()),
        "stem": _sum(F.when((n > 0) & ~F.array_contains("tokens", s), _bm25(n, df(s)) * (TOPIC_STEM if s in q.topic_stems else OTHER_STEM)).otherwise(0.0) for s, n in stf.items()),
        "proximity": F.when(F.size(places) >= 2, near).otherwise(0.0),
        "many": F.element_at(F.array(F.lit(0.0), F.lit(16.0), F.lit(40.0)), F.greatest(F.lit(1), F.least(F.lit(3), direct)).cast("int")),
    }


def negated(q_words: list[str], tokens: Column, reach: int = 3) -> Column:
    """True where a negating word stands within `reach` tokens of a word asked about, in its spelling or by its stem."""
    asked = F.transform(tokens, lambda t: t.isin(*q_words) | ct.stem(t).isin(*q_words)) if q_words else F.transform(tokens, lambda t: F.lit(False))
    return F.exists(F.transform(tokens, lambda t, i: t.isin(*ct.NEGATIONS) & F.exists(F.slice(asked, F.greatest(i - reach, F.lit(0)) + 1, F.lit(reach) + 1 + F.least(i, F.lit(reach))), lambda a: a)), lambda x: x)


def soft_similarity(a: Column, b: Column) -> Column:
    """Similarity of two tokens: within few edits, or for five letters and more nine tenths of their share of common trigrams from 0.55 on; else null."""
    share = ct.dice(a, b)
    return F.coalesce(ct.fuzzy(a, b), F.when((F.char_length(a) >= 5) & (F.char_length(b) >= 5) & (share >= 0.55), share * 0.9))


_ALIKE = {"fuzzy": ct.fuzzy, "_soft": lambda a, b: F.coalesce(ct.fuzzy(a, b), soft_similarity(a, b) * 0.85)}


def _near_words(docs: DataFrame, q: Question, most: int = 5000) -> list | None:
    """Tokens of the index that are nearly a word of the question, compared once for each different token; None where they are more than `most`."""
    if not q.soft:
        return []
    each = docs.select(F.explode("tokens").alias("token")).distinct().select("token", F.explode(F.array(*[F.lit(w) for w in q.soft])).alias("word"))
    said = each.select("token", "word", *[f(F.col("word"), F.col("token")).alias(name) for name, f in _ALIKE.items()])
    rows = said.filter((F.col("fuzzy") >= 0.75) | (F.col("_soft") >= 0.75)).limit(most + 1).collect()
    return rows if len(rows) <= most else None


def _first_hit(word: str, how: str, near: list | None) -> Column:
    """Points of the first token that is nearly `word`, 0 for none: looked up among the near words, or compared where these are too many."""
    if near is None:
        alike = F.transform("tokens", lambda t: _ALIKE[how](F.lit(word), t))
    else:
        known = {r["token"]: r[how] for r in near if r["word"] == word and (r[how] or 0) >= 0.75}
        if not known:
            return F.lit(0.0)
        pairs = F.create_map(*[F.lit(x) for kv in sorted(known.items()) for x in kv])
        alike = F.when(F.arrays_overlap("tokens", F.array(*[F.lit(t) for t in sorted(known)])), F.transform("tokens", lambda t: F.try_element_at(pairs, t)))
    return F.coalesce(F.get(F.filter(alike, lambda x: x >= 0.75), F.lit(0)), F.lit(0.0)) * FUZZY


def score(docs: DataFrame, q: Question, similarity: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """All messages with a score: docs columns, PARTS, `score`, `soft_score` (misspelt words count more freely), `candidate`, `polarity`, stored.

    `similarity` (chat_id, msg_id, similarity from 0 to 1) adds what vectors find; `learned` (chat_id, stem, related, weight) what earlier questions taught.
    """
    chats = _of_chat(docs, q, learned)
    rows = docs.join(checked_broadcast(chats, docs.select("chat_id").distinct().count()), "chat_id")
    if similarity is not None:
        rows = rows.join(similarity.select("chat_id", "msg_id", "similarity"), ["chat_id", "msg_id"], "left")
    rows = rows.withColumn("semantic", F.coalesce(F.col("similarity") * SEMANTIC, F.lit(0.0)) if similarity is not None else F.lit(0.0))
    rows = settled(counted(rows, q), lexical(q))
    weight = lambda s: F.when(~s.isin(*q.stems) if q.stems else F.lit(True), F.coalesce(F.try_element_at("_concepts", s), F.lit(0.0))).otherwise(0.0)
    rows = settled(rows, {"concept": F.when(F.col("_concepts").isNotNull(), F.aggregate("stems", F.lit(0.0), lambda a, s: a + weight(s) * CONCEPT)).otherwise(0.0)})
    unmatched = (F.col("direct_topic") == 0) & (F.col("phrase") == 0)
    near = _near_words(docs, q)
    rows = settled(rows, {name: F.when(unmatched, _sum(_first_hit(w, name, near) for w in q.soft)).otherwise(0.0) for name in ("fuzzy", "_soft")})
    of_target = F.coalesce((F.col("who") == F.col("_target")).cast("int"), F.lit(0)), F.coalesce(F.col("normal").contains(F.col("_target")).cast("int"), F.lit(0))
    on_topic = (F.col("direct_topic") > 0) | (F.col("stem") > 0) | (F.col("concept") > 0) | (F.col("phrase") > 0) | (F.col("semantic") > 0)

    def whole(fuzzy: str) -> tuple[Column, Column]:
        topical = on_topic | (F.col(fuzzy) > 0)
        alone = (10.0, 8.0) if q.of_person_alone else (0.0, 0.0)
        sender = _sum(F.when(topical, n * many).otherwise(n * few) for n, many, few in zip(of_target, (28.0, 24.0), alone, strict=True))
        parts = _sum(F.col(c) for c in ("phrase", "bm25", "stem", "concept", "proximity", "semantic", "many", fuzzy)) + sender
        return sender, F.when(topical | F.lit(q.of_person_alone), parts * F.col("quality")).otherwise(0.0)

    (sender, strict), (_, loose) = whole("fuzzy"), whole("_soft")
    found = (F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in q.words]).cast("array<string>"))) | F.arrays_overlap("stems", F.array(*[F.lit(s) for s in q.stems]).cast("array<string>"))
    named = F.coalesce(F.col("at") <= F.try_element_at("_until", F.col("who")), F.lit(False))
    rows = settled(rows, {"sender_points": sender, "score": strict, "soft_score": loose, "candidate": F.coalesce(found, F.lit(False)) | named | (F.col("semantic") > 0)})
    kept = rows.filter((F.col("score") > 0.8) | (F.col("soft_score") > 0.8))
    kept = kept.withColumn("polarity", F.when(F.arrays_overlap("said", F.array(*[F.lit(w) for w in ct.NEGATIONS])) & negated(q.words, F.col("said")), -1).otherwise(1))
    return materialize(kept.select("chat_id", "msg_id", "at", "sender", "asks", *[F.col("sender_points").alias(c) if c == "sender" else F.col(c) for c in PARTS if c != "sender"], "sender_points", "direct", "polarity", "candidate", "score", "soft_score"), "scored")


def choose_pass(scored: DataFrame, q: Question) -> DataFrame:
    """The rows of the first pass that gives enough, per chat: columns of `score` with `pass` and the final `score`.

    `strict`: candidates over 1.5, enough if there are three (one if the question is about a person alone) and the best has 8; `relaxed`: all messages over 0.8, enough with the best at 4;
    `fuzzy`: misspelt words too, the better score of each message.
    """
    least = 1 if q.of_person_alone else 3
    strict = F.col("candidate") & (F.col("score") > 1.5)
    some = scored.groupBy("chat_id").agg(F.max("candidate").alias("_any"))
    # without any candidate in a chat all its messages are
    scored = scored.join(some, "chat_id").withColumn("candidate", F.col("candidate") | ~F.col("_any")).drop("_any")
    seen = scored.groupBy("chat_id").agg(
        F.count_if(strict).alias("_n1"), F.max(F.when(strict, F.col("score"))).alias("_t1"), F.count_if(F.col("score") > 0.8).alias("_n2"), F.max("score").alias("_t2")
    )
    name = F.when((F.col("_n1") >= least) & (F.col("_t1") >= 8), "strict").when((F.col("_n2") >= least) & (F.col("_t2") >= 4), "relaxed").otherwise("fuzzy")
    judged = scored.join(seen.select("chat_id", name.alias("pass")), "chat_id")
    judged = judged.withColumn("score", F.when(F.col("pass") == "fuzzy", F.greatest("score", "soft_score")).otherwise(F.col("score"))).drop("soft_score")
    return judged.filter(F.when(F.col("pass") == "strict", strict).otherwise(F.col("score") > 0.8))


def confidence(chosen: DataFrame) -> DataFrame:
    """How far the evidence of each chat can be relied on, from 0 to 1, with its label; chats without evidence have no row."""
    best = F.max("score").over(Window.partitionBy("chat_id"))
    ranked = top(chosen.select("chat_id", "msg_id", "score"), ["chat_id"], [F.desc("score"), F.col("msg_id")], 2)
    two = ranked.groupBy("chat_id").agg(F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second"))
    rows = chosen.join(two, "chat_id").groupBy("chat_id", "first", "second").agg(F.count_if(F.col("score") >= F.col("first") * 0.5).alias("strong"), F.max(F.col("sender_points") > 0).alias("named"))
    f = F.col("first")
    base = F.when(f >= 70, 0.95).when(f >= 45, 0.85).when(f >= 25, 0.72).when(f >= 15, 0.55).when(f >= 8, 0.38).otherwise(0.2)
    add = lambda test, gain: F.when(test, gain).otherwise(0.0)
    total = base
    for test, gain in ((F.col("second") / f < 0.4, 0.05), (F.col("strong") >= 3, 0.05), (F.col("named"), 0.08)):
        total = F.least(F.lit(1.0), total + add(test, gain))
    out = rows.select("chat_id", F.round(total, 2).alias("confidence"))
    return out.withColumn("label", F.when(F.col("confidence") >= 0.75, "High").when(F.col("confidence") >= 0.45, "Medium").otherwise("Low"))


def in_context(chosen: DataFrame, docs: DataFrame, limit: int = 30) -> DataFrame:
    """The evidence of each chat in order of time: chat_id, msg_id, score, is_anchor.

    Up to six of the best are anchors, if they have a fifth of the best score and 2 points. An anchor brings its neighbours: after a question three, around a strong one two, else one; a question also the
    short answers that follow it, up to four, and what stands after each. Anchors come first, then what scores most, `limit` in all; of more than three in a row of one sender only three stay.
    """
    best = F.max("score").over(Window.partitionBy("chat_id"))
    ranked = top(chosen.select("chat_id", "msg_id", "at", "asks", "score"), ["chat_id"], [F.desc("score"), F.col("at")], max(1, min(6, limit // 2)))
    anchors = ranked.withColumn("_best", best).filter(F.col("score") >= F.greatest(F.lit(2.0), F.col("_best") * 0.2)).select("chat_id", "at", "asks", "score")
    before = F.when(F.col("asks"), 0).when(F.col("score") >= 50, 2).otherwise(1)
    after = F.when(F.col("asks"), 3).when(F.col("score") >= 25, 2).otherwise(1)
    near = anchors.select("chat_id", F.explode(F.sequence(F.col("at") - before, F.col("at") + after)).alias("at"), F.lit(False).alias("is_anchor"))
    steps = anchors.filter("asks").select("chat_id", F.col("at").alias("q"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"))
    said = steps.withColumn("at", F.col("q") + F.col("k")).join(docs.select("chat_id", "at", "answers"), ["chat_id", "at"])
    told = said.groupBy("chat_id", "q").agg(F.sort_array(F.collect_list(F.struct("k", "answers"))).alias("a"))
    # how many answers follow without a break
    length = F.aggregate("a", F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct((s["n"] + F.when(s["on"] & (x["answers"] != 0) & (x["k"] == s["n"] + 1), 1).otherwise(0)).alias("n"), (s["on"] & (x["answers"] != 0)).alias("on")))["n"]
    chain = told.select("chat_id", "q", length.alias("n")).filter("n > 0")
    answers = chain.select("chat_id", F.explode(F.sequence(F.col("q") + 1, F.col("q") + F.col("n"))).alias("at"), F.lit(True).alias("is_anchor"))
    beyond = chain.select("chat_id", F.explode(F.sequence(F.col("q") + 2, F.col("q") + F.col("n") + 1)).alias("at"), F.lit(False).alias("is_anchor"))
    places = anchors.select("chat_id", "at", F.lit(True).alias("is_anchor")).unionByName(near).unionByName(answers).unionByName(beyond)
    places = places.groupBy("chat_id", "at").agg(F.max("is_anchor").alias("is_anchor")).join(docs.select("chat_id", "at", "msg_id", "sender"), ["chat_id", "at"])
    rows = places.join(chosen.select("chat_id", "at", "score"), ["chat_id", "at"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy("chat_id").orderBy(F.desc("is_anchor"), F.desc("score"), "at")
    rows = rows.withColumn("_n", F.row_number().over(order)).filter((F.col("_n") <= limit) | F.col("is_anchor"))
    # what is left is at most `limit` and the anchors of a chat
    by_time = Window.partitionBy("chat_id").orderBy("at")
    rows = rows.withColumn("_new", (~F.col("sender").eqNullSafe(F.lag("sender").over(by_time)) | F.lag("at").over(by_time).isNull()).cast("int")).withColumn("_run", F.sum("_new").over(by_time))
    in_run = F.row_number().over(Window.partitionBy("chat_id", "_run").orderBy("at"))
    return rows.withColumn("_in", in_run).filter("_in <= 3").select("chat_id", "msg_id", "score", "is_anchor")


def retrieve(docs: DataFrame, q: Question, limit: int = 30, similarity: DataFrame | None = None, learned: DataFrame | None = None) -> DataFrame:
    """Evidence of every chat of an `index` for a question, `limit` clamped to 1..100: columns of `in_context`, `pass` and `confidence`."""
    if not q.words:
        return docs.limit(0).select("chat_id", "msg_id", F.lit(0.0).alias("score"), F.lit(False).alias("is_anchor"), F.lit("").alias("pass"), F.lit(0.0).alias("confidence"))
    chosen = materialize(choose_pass(score(docs, q, similarity, learned), q), "chosen")
    passes = chosen.groupBy("chat_id").agg(F.first("pass").alias("pass"))
    told = confidence(chosen).drop("label").join(passes, "chat_id")
    return in_context(chosen, docs, min(max(limit, 1), 100)).join(told, "chat_id")


def merged_evidence(first: DataFrame, again: DataFrame, limit: int = 30) -> DataFrame:
    """Evidence of a question and of its other wording: each message once, those of the first before the rest, cut to `limit` a chat; the better confidence."""
    both = first.withColumn("_source", F.lit(0)).unionByName(again.withColumn("_source", F.lit(1)))
    sure = both.groupBy("chat_id").agg(F.max("confidence").alias("confidence"))
    one = both.groupBy("chat_id", "msg_id").agg(F.min("_source").alias("_source"), F.max_by("score", -F.col("_source")).alias("score"))
    return top(one, ["chat_id"], [F.col("_source"), F.desc("score"), F.col("msg_id")], limit).drop("rank", "_source").join(sure, "chat_id")


def learn(evidence: DataFrame, docs: DataFrame, q: Question, least: float = 0.5) -> DataFrame:
    """What the evidence of a question teaches: chat_id, stem, related, weight. Each row of evidence ties the question's stems to its first five other stems by 0.06, 2 at most; only
    chats with a confidence of at least `least` teach. Pronouns and stems under three letters count among the five but aren't kept."""
    terms = [s for w, s in zip(q.topic, q.topic_stems, strict=False) if len(w) >= 3]
    rows = evidence.filter(F.col("confidence") >= least).join(docs.select("chat_id", "msg_id", "stems"), ["chat_id", "msg_id"])
    five = lambda s: F.slice(F.filter(F.array_distinct("stems"), lambda x: x != s), 1, 5)
    pairs = [rows.select("chat_id", F.lit(s).alias("stem"), F.explode(five(F.lit(s))).alias("related")) for s in terms]
    if not pairs:
        return docs.limit(0).select("chat_id", F.lit("").alias("stem"), F.lit("").alias("related"), F.lit(0.0).alias("weight"))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    kept = out.filter((F.char_length("related") >= 3) & ~F.col("related").isin(*PRONOUNS) & (F.char_length("stem") >= 3))
    return kept.groupBy("chat_id", "stem", "related").agg(F.least(F.lit(2.0), F.round(F.count("*") * 0.06, 2)).alias("weight"))
