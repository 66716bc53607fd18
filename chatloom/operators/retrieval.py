"""Evidence for questions: inverted index tables, scores and context, as joins over tokens.

An index is a set of tables by chat_id: postings, document frequencies, lengths, co-occurrences. A question is a handful of
terms, so joins against it are broadcast; everything that grows with the corpus is aggregated in the tasks first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.functions import chattext as ct
from chatloom.operators.pairs import count_pairs
from chatloom.operators.report import top
from chatloom.session import checked_broadcast, materialize

K1, B = 1.4, 0.75
#: Characters of stems that a group of messages holds, of which a task may hold all, and that a task takes in the mean.
BLOCK_CHARS, TASK_CHARS = 1 << 23, 1 << 21


def postings(m: DataFrame) -> DataFrame:
    """One row per meaningful token: chat_id, msg_id, pos, token, stem."""
    long = m.select("chat_id", "msg_id", F.posexplode(ct.meaningful(F.col("message"))).alias("pos", "token"))
    return long.withColumn("stem", ct.stem(F.col("token")))


def corpus_stats(m: DataFrame) -> DataFrame:
    """Messages of a chat and their mean length in tokens, 1 at least."""
    n = F.size(ct.meaningful(F.col("message")))
    return m.groupBy("chat_id").agg(F.count("*").alias("docs"), F.greatest(F.avg(n), F.lit(1.0)).alias("average_tokens"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("chat_id", "token").agg(F.count_distinct("msg_id").alias("df"))


def stem_totals(posts: DataFrame) -> DataFrame:
    return posts.groupBy("chat_id", "stem").agg(F.count("*").alias("occurrences"))


def cooccurrence(m: DataFrame, reach: int = 2, least: int = 2, block: int = BLOCK_CHARS) -> DataFrame:
    """Stem pairs within `reach` messages of one run of a date: for each occurrence of the first, 1 per distinct other stem nearby.

    Only texts are shuffled, as their stems, once: a task counts the pairs of whole chats. A chat with more than `block` characters of stems is cut into blocks of
    message numbers, each with the `reach` messages before and after; only the counts of its blocks are shuffled, to be added.
    """
    stems = F.array_join(F.transform(ct.meaningful(F.col("message")), ct.stem), " ")
    rows = materialize(m.filter(F.col("chat_id").isNotNull() & F.col("msg_id").isNotNull()).select("chat_id", "msg_id", "date", stems.alias("stems")), "stems")
    sizes = rows.groupBy("chat_id").agg(F.sum(F.char_length("stems")).alias("chars"), F.count("*").alias("n"), F.min("msg_id").alias("lowest"))
    total = sizes.agg(F.sum("chars"), F.count_if(F.col("chars") > block)).first()
    tasks = max(1, -(-(total[0] or 0) // TASK_CHARS))

    def counted(parts: DataFrame, least: int) -> DataFrame:
        groups = parts.select("chat_id", "block", "msg_id", "own", "date", "stems").repartition(tasks, "chat_id", "block").sortWithinPartitions("chat_id", "block", "msg_id")
        return groups.mapInArrow(lambda batches: count_pairs(batches, reach, least), f"chat_id {rows.schema['chat_id'].dataType.simpleString()}, a STRING, b STRING, n BIGINT")

    whole = {"block": F.lit(0).cast("bigint"), "own": F.lit(True)}
    if not total[1]:
        return counted(rows.withColumns(whole), least)
    # as many message numbers as messages of the chat's mean length fill a block
    width = F.greatest(F.lit(1), F.floor(F.col("n") * block / F.col("chars")))
    long = checked_broadcast(sizes.filter(F.col("chars") > block).select("chat_id", "lowest", width.alias("width")), total[1])
    cut = rows.join(long, "chat_id").withColumns({"block": F.expr("(msg_id - lowest) div width"), "own": F.lit(True)}).drop("lowest", "width")
    parts = counted(cut.unionByName(_across_blocks(cut, reach)), 1).groupBy("chat_id", "a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return counted(rows.join(long, "chat_id", "left_anti").withColumns(whole), least).unionByName(parts)


def _across_blocks(cut: DataFrame, reach: int) -> DataFrame:
    """The `reach` rows before and after each block of a chat, as rows of that block that aren't its own."""
    side = lambda order, name: cut.withColumn(name, F.row_number().over(Window.partitionBy("chat_id", "block").orderBy(order))).filter(F.col(name) <= reach).drop(name)
    # what lies inside a block is in reach of no other, so the edges of a chat hold its neighbours in order
    edges = side(F.col("msg_id"), "_nth").unionByName(side(F.desc("msg_id"), "_nth")).dropDuplicates(["chat_id", "msg_id"])
    order = Window.partitionBy("chat_id").orderBy("msg_id")
    around = edges.withColumn("_around", F.array(*[f("block", k).over(order) for k in range(1, reach + 1) for f in (F.lag, F.lead)]))
    sent = around.withColumn("_to", F.explode(F.array_except(F.array_compact("_around"), F.array("block")))).drop("_around")
    return sent.withColumns({"block": F.col("_to"), "own": F.lit(False)}).drop("_to")


def question_terms(question: str) -> list[str]:
    """The distinct words a question is about, in the spelling and stop words of the index; driver-side, as a question is one short text."""
    import regex

    found = regex.findall(r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*", question.lower().replace("’", "'"))
    usual = [ct.CANONICAL.get(t, t) for t in found]
    return list(dict.fromkeys(t for t in usual if len(t) >= 2 and t not in ct.LIGHT_STOP_WORDS and t not in ct.INTERROGATIVES and t not in ("did", "does", "do")))


def bm25(m: DataFrame, terms: list[str]) -> DataFrame:
    """BM25 of each message that holds a term: chat_id, msg_id, score, matched."""
    toks = m.select("chat_id", "msg_id", ct.meaningful(F.col("message")).alias("t"))
    stats = toks.groupBy("chat_id").agg(F.count("*").alias("docs"), F.greatest(F.avg(F.size("t")), F.lit(1.0)).alias("average"))
    hits = toks.filter(F.arrays_overlap("t", F.array(*[F.lit(x) for x in terms])))
    hits = hits.select("chat_id", "msg_id", F.size("t").alias("len"), F.explode(F.filter("t", lambda t: t.isin(*terms))).alias("token"))
    tf = hits.groupBy("chat_id", "msg_id", "len", "token").agg(F.count("*").alias("tf"))
    df = tf.groupBy("chat_id", "token").agg(F.count("*").alias("df"))
    both = tf.join(df, ["chat_id", "token"]).join(stats, "chat_id")
    idf = F.ln((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("average")))
    return both.groupBy("chat_id", "msg_id").agg(F.sum(F.greatest(F.lit(0.0), idf * norm)).alias("score"), F.count("*").alias("matched"))


def fuzzy_terms(posts: DataFrame, terms: list[str]) -> DataFrame:
    """Tokens of the vocabulary that are nearly a term: term, token, similarity. The vocabulary is distinct first; terms are few literals."""
    vocabulary = posts.select("token").distinct().filter(F.char_length("token") >= 4)
    each = vocabulary.select("token", F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
    return each.withColumn("similarity", ct.fuzzy(F.col("term"), F.col("token"))).filter(F.col("similarity").isNotNull() & (F.col("term") != F.col("token")))


def soft_terms(posts: DataFrame, terms: list[str], least: float = 0.55) -> DataFrame:
    """Tokens of five letters or more that share trigrams with a term: term, token, share (Dice), at least `least`."""
    vocabulary = posts.select("token").distinct().filter(F.char_length("token") >= 5)
    each = vocabulary.select("token", F.explode(F.array(*[F.lit(t) for t in terms])).alias("term"))
    return each.withColumn("share", F.round(ct.dice(F.col("term"), F.col("token")), 6)).filter((F.col("share") >= least) & (F.col("term") != F.col("token")))


def ngram_counts(m: DataFrame, n: int, least: int = 2) -> DataFrame:
    """Runs of `n` meaningful tokens that a chat says `least` times or more: chat_id, gram, n."""
    toks = m.select("chat_id", ct.meaningful(F.col("message")).alias("t")).filter(F.size("t") >= n)
    grams = F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))
    return toks.select("chat_id", F.explode(grams).alias("gram")).groupBy("chat_id", "gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def fingerprints(m: DataFrame) -> DataFrame:
    """A number that tells whether the messages of a chat are the same as before, whatever their order: chat_id, messages, fingerprint."""
    return m.groupBy("chat_id").agg(F.count("*").alias("messages"), F.bit_xor(F.xxhash64("msg_id", "sender", "date", "message")).alias("fingerprint"))


def nearest_vectors(vectors: DataFrame, every: int = 50, k: int = 10, block_rows: int = 2048, least: float = 0.55) -> DataFrame:
    """For each vector whose id is divisible by `every` the `k` nearest of all others by (cosine + 1) / 2, at least `least`.

    Rows and queries are cut into blocks by id; each pair of blocks is one matrix product, of which only k rows a query leave the task. Vectors of
    another dimension than the query's, null and zero vectors aren't near anything.
    """
    import numpy as np
    import pandas as pd

    rows = vectors.filter(F.col("embedding").isNotNull()).select("vec_id", "embedding")
    queries = rows.filter(F.col("vec_id") % every == 0)
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // block_rows)), max(1, -(-n_queries // block_rows))
    left = rows.withColumn("rb", F.pmod(F.xxhash64("vec_id"), F.lit(row_blocks))).select("rb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), "vec_id", "embedding")
    right = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).select(F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), "qb", F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    right = right.withColumn("rb", F.col("rb").cast("bigint"))

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in set(map(len, right["query"])) if len(left) and len(right) else ():
            a, q = left[left["embedding"].map(len) == size], right[right["query"].map(len) == size]
            if not len(a) or not size:
                continue
            am, qm = np.stack(a["embedding"]).astype(np.float64), np.stack(q["query"]).astype(np.float64)
            an, qn = np.linalg.norm(am, axis=1), np.linalg.norm(qm, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = ((qm @ am.T) / (qn[:, None] * an[None, :]) + 1) / 2
            sim = np.where(np.isfinite(sim), sim, -1.0)
            sim[q["query_id"].to_numpy()[:, None] == a["vec_id"].to_numpy()[None, :]] = -1.0
            order = np.lexsort((np.broadcast_to(a["vec_id"].to_numpy(), sim.shape), -np.round(sim, 9)), axis=1)[:, :k]
            for i, qid in enumerate(q["query_id"]):
                out += [(qid, int(a["vec_id"].iloc[j]), float(sim[i, j])) for j in order[i] if sim[i, j] >= least]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "similarity"]).astype({"query_id": "int64", "vec_id": "int64", "similarity": "float64"})

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(product, "query_id BIGINT, vec_id BIGINT, similarity DOUBLE")
    return top(found, ["query_id"], [F.desc(F.round("similarity", 9)), F.col("vec_id")], k).select("query_id", "rank", "vec_id", F.round("similarity", 6).alias("similarity"))
