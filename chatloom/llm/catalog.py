"""Queries over the problems of text preparation; each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatloom.llm import language, leakage, lookalike, packing, pii, quality, threads
from chatloom.operators.timeline import dated_rows
from chatloom.session import materialize, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.find_lookalikes(table(spark, sf_dir, "messages"), "row_id", ["time", "sender", "message"]).select("row_id", "field")


def p2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every time, sender and message in its one form."""
    fields = ["time", "sender", "message"]
    return lookalike.normalise(table(spark, sf_dir, "messages"), fields).select("row_id", *[f"{f}_normal" for f in fields])


def _scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages")
    trees = language.fit_languages(messages, "message", "lang")
    return language.detect(language.lines_to_score(messages), "line", trees)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scored_lines(spark, sf_dir).filter(F.col("detected").isNotNull() & ~F.col("detected").eqNullSafe(F.col("lang")))
    return found.select("row_id", "line_no", F.col("detected").alias("lang"))


def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each message as a whole, with its confidence."""
    messages = table(spark, sf_dir, "messages")
    trees = language.fit_languages(messages, "message", "lang")
    return language.detect(messages.select("row_id", "message"), "message", trees).select("row_id", F.col("detected").alias("lang"), "confidence")


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each line of each message, however short, with its confidence; a line without letters has neither."""
    messages = table(spark, sf_dir, "messages")
    trees = language.fit_languages(messages, "message", "lang")
    lines = language.message_lines(messages.select("row_id", "message"))
    return language.detect(lines, "line", trees).select("row_id", "line_no", F.col("detected").alias("lang"), "confidence")


def _personal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages, facts = table(spark, sf_dir, "messages"), table(spark, sf_dir, "person_facts")
    return messages.select(F.lit("messages").alias("tbl"), F.col("row_id").alias("id"), F.col("message").alias("text")).unionByName(
        facts.select(F.lit("person_facts").alias("tbl"), F.col("fact_id").alias("id"), F.col("evidence").alias("text"))
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = pii.known_given_names(table(spark, sf_dir, "messages"))
    items = pii.find_pii(_personal_texts(spark, sf_dir), "text", names).select("tbl", "id", F.explode(F.array_distinct(F.transform("found", lambda s: F.struct(s["kind"].alias("kind"), s["piece"].alias("piece"))))).alias("item"))
    return items.select("tbl", "id", "item.kind", "item.piece")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message and every piece of evidence, whole, with typed placeholders."""
    names = pii.known_given_names(table(spark, sf_dir, "messages"))
    return pii.redact_column(_personal_texts(spark, sf_dir), "text", names).select("tbl", "id", "text_redacted")


def _threads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return threads.rebuild(dated_rows(table(spark, sf_dir, "messages"), table(spark, sf_dir, "exports")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, runs, _ = _threads(spark, sf_dir)
    return threads.conversations(runs).filter("kept").select("chat_id", "first_msg_id", "last_msg_id", "n_messages")


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of kept conversations in order, each by the opener or a replier."""
    messages, runs, _ = _threads(spark, sf_dir)
    return threads.turns(messages, materialize(runs, "placed"))


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the pointers by time and by number end in each chat: at a root, at an absent number, or never."""
    return threads.broken_links(_threads(spark, sf_dir)[2])


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = packing.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens")
    return packing.pack(materialize(docs, "tokens"), table(spark, sf_dir, "container_sizes"))


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each piece of each document, for every capacity."""
    return _packed(spark, sf_dir)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(_packed(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).filter("kind = 'exact'").select("doc_id", "item_id").distinct()


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and edited copies of passages, with their alignment score."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id", "kind", F.round("score", 6).alias("score"), "run")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs that share a rare seed, with alignment score and longest common run, whether leaks or not."""
    return leakage.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.learned_rules(table(spark, sf_dir, "messages"))
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), rules)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).filter(F.col("kind") != "prose").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document."""
    stats = quality.statistics(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return stats.select("doc_id", "n_words", "n_lines", "mean_word_length", "symbol_share", "digit_share", "end_mark_share", "common_word_share")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_normalised, p4_found, p4_lines, p4_messages, p5_found, p5_redacted, p6_found, p6_turns, p6_links, p8_packed, p8_fill, p9_found, p9_leaks, p9_scores, p10_found, p10_statistics)
}
ORACLES: dict[str, str] = {}
