"""Queries of the activity report, each with the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import chattext as ct
from chatloom.operators import answers, questions, report
from chatloom.session import materialize, table


def _on_messages(section):
    return lambda spark, sf_dir: section(report.chat_messages(table(spark, sf_dir, "messages")))


def _stored(section):
    """For what has several sections: the messages are read and deduplicated once."""
    return lambda spark, sf_dir: section(materialize(report.chat_messages(table(spark, sf_dir, "messages")), "view"))


def _first_page(m, sender):
    return report.browse(m, 1, 100, sender=sender).select("chat_id", "msg_id", "sender", "message", "total", "total_pages")


def _on_dated(section):
    """Over messages dated by their stamps; the SQL of the report_ queries has the old parser's ts instead."""

    def run(spark, sf_dir):
        m = report.dated_chat_messages(table(spark, sf_dir, "messages"), table(spark, sf_dir, "exports"))
        return section(materialize(m, "report"))

    return run


QUERIES = {
    "report_overview": _on_messages(report.overview),
    "report_participants": _on_messages(report.participants),
    "report_length_by_person": _on_messages(report.length_by_person),
    "report_by_date": _on_messages(report.by_date),
    "report_by_hour": _on_messages(report.by_hour),
    "report_by_weekday": _on_messages(report.by_weekday),
    "report_by_month": _on_messages(report.by_month),
    "report_longest_message": _on_messages(report.longest_message),
    "report_top_emojis": _on_messages(report.top_emojis),
    "report_emojis_per_person": _on_messages(report.emojis_per_person),
    "report_top_words": _on_messages(report.top_words),
    "report_words_by_person": _on_messages(report.words_by_person),
    "report_conversation_starters": _on_messages(report.conversation_starters),
    "report_numbered_conversations": _on_messages(report.numbered_conversations),
    "report_response_stats": _on_messages(report.response_stats),
    "report_fastest_response": _on_messages(report.fastest_response),
    "report_reply_pairs": _on_messages(report.reply_pairs),
    "report_night_share": _on_messages(report.night_share),
    "report_streaks": _on_messages(report.streaks),
    "report_biggest_day": _on_messages(report.biggest_day),
    "report_most_talkative": _on_messages(report.most_talkative),
    "report_vibe": _on_messages(report.vibe),
    "report_aliases": _on_messages(report.aliases),
    "report_floods_collapsed": _on_messages(report.collapse_floods),
    "report_page": _on_messages(report.page),
    "report_search": _on_messages(lambda m: report.page(m, 1, 100, text="night")),
    "report_browse": _on_messages(lambda m: report.browse(m, 2)),
    "report_browse_search": _on_messages(lambda m: report.browse(m, 1, 100, text="night")),
    "report_persona": _stored(report.persona),
    "report_highlights": _stored(report.highlights),
    "dated_coverage": _on_dated(report.coverage),
    "dated_overview": _on_dated(report.overview),
    "dated_by_hour": _on_dated(report.by_hour),
    "dated_by_weekday": _on_dated(report.by_weekday),
    "dated_by_month": _on_dated(report.by_month),
    "dated_conversation_starters": _on_dated(report.conversation_starters),
    "dated_numbered_conversations": _on_dated(report.numbered_conversations),
    "dated_response_stats": _on_dated(report.response_stats),
    "dated_fastest_response": _on_dated(report.fastest_response),
    "dated_reply_pairs": _on_dated(report.reply_pairs),
    "dated_night_share": _on_dated(report.night_share),
    "dated_streaks": _on_dated(report.streaks),
    "dated_biggest_day": _on_dated(report.biggest_day),
    "dated_vibe": _on_dated(report.vibe),
    "dated_persona": _on_dated(report.persona),
    "dated_highlights": _on_dated(report.highlights),
    "dated_reply_speed": _on_dated(lambda m: answers.answer(m, "Who replies faster?")),
    "report_word_cloud": _on_messages(report.word_cloud),
    "report_month_rhythm": _on_messages(report.month_rhythm),
    "report_records": _stored(report.records),
    "report_tiles": _stored(report.tiles),
    "report_aliased": _on_messages(lambda m: report.length_by_person(report.aliased(m))),
    "report_of_sender": lambda s, d: _first_page(report.chat_messages(table(s, d, "messages")), "farah"),
    "report_context": _stored(lambda m: report.overview(m).join(report.night_share(m), "chat_id", "left").join(report.most_talkative(m).select("chat_id", F.col("sender").alias("most_talkative")), "chat_id", "left")),
    "answer_longer_messages": _on_messages(lambda m: answers.answer(m, "Who sends longer messages?")),
    "answer_total": _on_messages(lambda m: answers.answer(m, "How many messages are there?")),
    "answer_reply_speed": _on_messages(lambda m: answers.answer(m, "kaun jaldi reply karta hai")),
    "answer_starter": _on_messages(lambda m: answers.answer(m, "Who starts conversations?")),
    "answer_emoji_user": _on_messages(lambda m: answers.answer(m, "Who uses more emojis?")),
    "answer_busiest_day": _stored(lambda m: answers.answer(m, "What is the busiest day?")),
    "answer_busiest_hour": _on_messages(lambda m: answers.answer(m, "What is the most active hour?")),
    "answer_top_emoji": _on_messages(lambda m: answers.answer(m, "What is the most used emoji?")),
    "text_question_types": _on_messages(lambda m: m.groupBy("chat_id", questions.question_type(F.col("message")).alias("kind")).agg(F.count("*").alias("n"))),
    "text_masked": _on_messages(lambda m: m.select("chat_id", "msg_id", ct.masked(F.col("message")).alias("masked")).filter(F.col("masked") != m["message"])),
    "text_quality": _on_messages(lambda m: m.groupBy("chat_id", ct.quality(F.col("message")).alias("quality")).agg(F.count("*").alias("n"))),
    "text_questions": _on_messages(lambda m: m.filter(ct.is_question(F.col("message"))).select("chat_id", "msg_id")),
    "text_short_answers": _on_messages(lambda m: m.select("chat_id", "msg_id", ct.short_answer(F.col("message")).alias("answer")).filter("answer <> 0")),
}

_M = """
WITH m AS (
  SELECT chat_id, msg_id, row_id, date, ts, sender, coalesce(message, '') AS message
  FROM messages WHERE NOT coalesce(is_system, false) AND sender IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY chat_id, msg_id ORDER BY row_id) = 1
)"""
_LEN = "(length(message) + length(regexp_replace(message, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"
_SEC = "epoch(ts)::BIGINT"
_REPLIES = _M + """, r AS (
  SELECT chat_id, msg_id, sender, ts, message, lag(sender) OVER w AS prev_sender, lag(msg_id) OVER w AS prev_msg_id,
         (epoch(ts) - epoch(lag(ts) OVER w)) / 60.0 AS gap_minutes, row_number() OVER w AS nth
  FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY msg_id)
), q AS (SELECT *, nth = 1 OR coalesce(gap_minutes >= 120, false) AS starts FROM r),
a AS (SELECT * FROM q WHERE sender <> prev_sender AND gap_minutes BETWEEN 0 AND 1440)
"""
_STOPS = "(" + ",".join(f"'{w}'" for w in ct.STOP_WORDS) + ")"
_WORDS = _M + f""", w0 AS (
  SELECT chat_id, sender, msg_id, string_split_regex(regexp_replace(lower(message), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+') AS ws FROM m
), w1 AS (SELECT chat_id, sender, msg_id, list_filter(ws, lambda x: length(x) > 2 AND x NOT IN {_STOPS}) AS ws FROM w0),
w AS (SELECT chat_id, sender, msg_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w1)
"""
_NUM = "CASE WHEN regexp_full_match(word, '0|[1-9][0-9]{0,9}') THEN word::BIGINT END ASC NULLS LAST"


def _emoji(sql: str) -> str:
    return sql.replace("{EMOJI}", ct.emoji_class())


_TOKENS = _M + ", n0 AS (SELECT chat_id, msg_id, message, regexp_replace(regexp_replace(message, '[\\x{200B}-\\x{200D}\\x{FEFF}]', '', 'g'), '[‘’]', '''', 'g') AS t FROM m)"
for _i, (_short, _full) in enumerate(ct.CONTRACTIONS):
    _TOKENS += f", n{_i + 1} AS (SELECT chat_id, msg_id, message, regexp_replace(t, '(?i)\\b{_short.replace(chr(39), chr(39) * 2)}\\b', '{_full}', 'g') AS t FROM n{_i})"
# a run of a character counts at most twice
_TOKENS += f", nr AS (SELECT chat_id, msg_id, message, string_split(t, '') AS cs FROM n{len(ct.CONTRACTIONS)}), nz AS (SELECT chat_id, msg_id, message, array_to_string(list_filter(cs, lambda x, i: NOT (i > 2 AND x = cs[i - 1] AND x = cs[i - 2])), '') AS t FROM nr)"
_TOKENS += f", tk AS (SELECT chat_id, msg_id, message, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+(?:[-''][\\p{{L}}\\p{{N}}]+)*') AS tokens FROM nz)"


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


_BOILER = " OR ".join(
    f"contains(lower(message), '{b}')"
    for b in ("messages and calls are end-to-end encrypted", "this message was deleted", "you deleted this message", "<media omitted>", "missed voice call", "missed video call")
)
_MASKS = [
    (r"\b\d{4}([\s-]?)\d{4}([\s-]?)\d{4}([\s-]?)\d{4}\b", r"XXXX\1XXXX\2XXXX\3XXXX"),
    (r"(\+\d{1,3})([\s-]?)\d{5}([\s-]?)\d{5}", r"\1\2XXXXX\3XXXXX"),
    (r"\b\d{10}\b", "X" * 10),
    (r"\b([A-Za-z0-9_.+-]+)@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_.-]+)+\b", r"\1@XXXXX"),
    (rf"(?i)\b([A-Za-z0-9_.-]+)@(?:{'|'.join(ct.PAY_HANDLES)})\b", r"\1@XXXXX"),
    *[(rf"(?i)\b((?:{ct.CODE_WORDS})\b[^0-9\n]{{0,12}})\d{{{n}}}\b", r"\1" + "X" * n) for n in range(8, 3, -1)],
]


def masked_sql(column: str) -> str:
    for pattern, by in _MASKS:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return column



ORACLES = {
    "report_overview": _M + f"""
SELECT chat_id, count(*) AS total_messages, count(DISTINCT sender) AS participants, sum({_LEN})::BIGINT AS total_characters,
  floor(avg({_LEN}) + 0.5)::BIGINT AS average_length, sum(len(regexp_extract_all(message, '(?i)https?://\\S+')))::BIGINT AS links,
  count(*) FILTER (contains(message, '<Media omitted>') OR contains(message, 'image omitted') OR contains(message, 'video omitted') OR contains(message, 'audio omitted')) AS media_messages,
  count(*) FILTER (contains(lower(message), 'this message was deleted')) AS deleted_messages,
  strftime(min(ts), '%d/%m/%Y') AS first_date, strftime(max(ts), '%d/%m/%Y') AS last_date,
  floor((epoch(max(ts)) - epoch(min(ts))) / 86400.0 + 0.5)::BIGINT AS duration_days
FROM m GROUP BY chat_id""",
    "report_participants": _M + "SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY first_msg_id) AS place FROM (SELECT chat_id, sender, min(msg_id) AS first_msg_id, count(*) AS messages FROM m GROUP BY ALL)",
    "report_length_by_person": _M + f"SELECT chat_id, sender, count(*) AS messages, sum({_LEN})::BIGINT AS characters, floor(avg({_LEN}) + 0.5)::BIGINT AS average_length, max({_LEN}) AS longest FROM m GROUP BY ALL",
    "report_by_date": _M + "SELECT chat_id, date, count(*) AS messages FROM m GROUP BY ALL",
    "report_by_hour": _M + """SELECT c.chat_id, h.hour, count(m.msg_id) AS messages FROM (SELECT DISTINCT chat_id FROM m WHERE ts IS NOT NULL) c
CROSS JOIN (SELECT unnest(range(24))::INT AS hour) h LEFT JOIN m ON m.chat_id = c.chat_id AND hour(m.ts) = h.hour GROUP BY ALL""",
    "report_by_weekday": _M + "SELECT chat_id, dayname(ts) AS weekday, count(*) AS messages FROM m WHERE ts IS NOT NULL GROUP BY ALL",
    "report_by_month": _M + "SELECT *, floor(100.0 * messages / max(messages) OVER (PARTITION BY chat_id) + 0.5)::BIGINT AS percent_of_busiest FROM (SELECT chat_id, strftime(ts, '%Y-%m') AS month, count(*) AS messages FROM m WHERE ts IS NOT NULL GROUP BY ALL)",
    "report_longest_message": _M + f"SELECT chat_id, msg_id, sender, {_LEN} AS length FROM m QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY {_LEN} DESC, msg_id) = 1",
    "report_top_emojis": _emoji(_M + """, e0 AS (SELECT chat_id, msg_id, regexp_extract_all(message, '{EMOJI}') AS es FROM m),
e AS (SELECT chat_id, msg_id, unnest(es) AS emoji, generate_subscripts(es, 1) AS pos FROM e0),
c AS (SELECT chat_id, emoji, count(*) AS n, min(msg_id * 100000 + pos) AS first FROM e GROUP BY ALL)
SELECT chat_id, rank, emoji, n FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, first) AS rank FROM c) WHERE rank <= 10"""),
    "report_emojis_per_person": _emoji(_M + "SELECT chat_id, sender, sum(len(regexp_extract_all(message, '{EMOJI}')))::BIGINT AS emojis FROM m GROUP BY ALL HAVING emojis > 0"),
    "report_top_words": _WORDS + f""", c AS (SELECT chat_id, word, count(*) AS n, min(msg_id * 100000 + pos) AS first FROM w GROUP BY ALL)
SELECT chat_id, rank, word, n, total_words FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, {_NUM}, first) AS rank, (sum(n) OVER (PARTITION BY chat_id))::BIGINT AS total_words FROM c) WHERE rank <= 20""",
    "report_words_by_person": _WORDS + f""", c AS (SELECT chat_id, sender, word, count(*) AS n, min(msg_id * 100000 + pos) AS first FROM w GROUP BY ALL)
SELECT p.chat_id, p.sender, t.rank::INT AS rank, t.word, t.n FROM (SELECT DISTINCT chat_id, sender FROM m) p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, sender ORDER BY n DESC, {_NUM}, first) AS rank FROM c) WHERE rank <= 10) t USING (chat_id, sender)""",
    "report_conversation_starters": _REPLIES + "SELECT *, floor(100.0 * starts / total + 0.5)::BIGINT AS percentage FROM (SELECT *, (sum(starts) OVER (PARTITION BY chat_id))::BIGINT AS total FROM (SELECT chat_id, sender, count(*) AS starts FROM q WHERE starts GROUP BY ALL))",
    "report_numbered_conversations": _REPLIES + "SELECT chat_id, msg_id, sender, starts, (sum(starts::INT) OVER (PARTITION BY chat_id ORDER BY msg_id))::BIGINT AS conversation FROM q",
    "report_response_stats": _REPLIES + "SELECT chat_id, sender, count(*) AS responses, floor(avg(gap_minutes) * 10 + 0.5) / 10.0 AS average_minutes, floor(min(gap_minutes) * 10 + 0.5) / 10.0 AS fastest_minutes, floor(median(gap_minutes) * 10 + 0.5) / 10.0 AS median_minutes FROM a GROUP BY ALL",
    "report_fastest_response": _REPLIES + "SELECT chat_id, sender AS responder, gap_minutes, msg_id, prev_sender, prev_msg_id FROM a QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY gap_minutes, msg_id) = 1",
    "report_reply_pairs": _REPLIES + """, c AS (SELECT chat_id, prev_sender AS from_sender, sender AS to_sender, count(*) AS replies, min(msg_id) AS first FROM a WHERE gap_minutes <= 120 GROUP BY ALL)
SELECT chat_id, rank, from_sender, to_sender, replies FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY replies DESC, first) AS rank FROM c) WHERE rank <= 10""",
    "report_night_share": _M + """, h AS (SELECT chat_id, hour(ts) AS hour, count(*) AS n FROM m WHERE ts IS NOT NULL GROUP BY ALL),
p AS (SELECT chat_id, hour AS peak_hour FROM h QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, hour) = 1)
SELECT h.chat_id, floor(100.0 * sum(CASE WHEN hour >= 22 OR hour < 5 THEN n ELSE 0 END) / sum(n) + 0.5)::BIGINT AS night_percent, any_value(peak_hour) AS peak_hour FROM h JOIN p USING (chat_id) GROUP BY h.chat_id""",
    "report_streaks": _M + """, d AS (SELECT DISTINCT chat_id, ts::DATE AS day FROM m WHERE ts IS NOT NULL),
i AS (SELECT *, day - (row_number() OVER (PARTITION BY chat_id ORDER BY day))::INT AS island FROM d),
r AS (SELECT chat_id, island, count(*)::INT AS days, min(day) AS first_day, max(day) AS last_day FROM i GROUP BY ALL)
SELECT chat_id, days, first_day, last_day FROM r QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY days DESC, first_day) = 1""",
    "report_biggest_day": _M + "SELECT chat_id, day, messages FROM (SELECT chat_id, ts::DATE AS day, count(*) AS messages, min(msg_id) AS first FROM m WHERE ts IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY messages DESC, first) = 1",
    "report_most_talkative": _M + "SELECT chat_id, sender, messages, floor(100.0 * messages / total + 0.5)::BIGINT AS percent FROM (SELECT *, sum(messages) OVER (PARTITION BY chat_id) AS total FROM (SELECT chat_id, sender, count(*) AS messages, min(msg_id) AS first FROM m GROUP BY ALL)) QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY messages DESC, first) = 1",
    "report_vibe": _REPLIES + """, n AS (SELECT chat_id, sender, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT chat_id, sender, count(*) AS s FROM q WHERE starts GROUP BY ALL),
v AS (SELECT chat_id, sender, floor(avg(gap_minutes) * 10 + 0.5) / 10.0 AS r FROM a GROUP BY ALL),
p AS (SELECT chat_id, max(n) AS n1, sum(n) AS n2, max(coalesce(s, 0)) AS s1, sum(s) AS s2, count(r) AS rn, min(r) AS r1, max(r) AS r2
      FROM n LEFT JOIN s USING (chat_id, sender) LEFT JOIN v USING (chat_id, sender) GROUP BY chat_id HAVING count(*) = 2),
k AS (SELECT chat_id, list_filter([greatest(0.0, floor(100 - 2 * abs(100.0 * n1 / n2 - 50) + 0.5)), CASE WHEN s2 > 0 THEN greatest(0.0, floor(100 - 2 * abs(100.0 * s1 / s2 - 50) + 0.5)) END,
      CASE WHEN rn = 2 AND r2 > 0 THEN floor(100.0 * r1 / r2 + 0.5) END], lambda x: x IS NOT NULL) AS parts FROM p)
SELECT chat_id, floor(list_sum(parts) / len(parts) + 0.5)::BIGINT AS score FROM k WHERE len(parts) >= 2""",
    "report_aliases": _M + "SELECT chat_id, sender, 'Person ' || CASE WHEN n <= 26 THEN chr((64 + n)::INT) ELSE n::VARCHAR END AS alias FROM (SELECT chat_id, sender, row_number() OVER (PARTITION BY chat_id ORDER BY sender) AS n FROM (SELECT DISTINCT chat_id, sender FROM m))",
    "report_floods_collapsed": _M + """, c AS (SELECT chat_id, msg_id, sender, coalesce(lag(sender) OVER (PARTITION BY chat_id ORDER BY msg_id) <> sender, true) AS changed FROM m),
r AS (SELECT *, sum(changed::INT) OVER (PARTITION BY chat_id ORDER BY msg_id) AS run FROM c)
SELECT chat_id, msg_id, sender, in_run FROM (SELECT *, row_number() OVER (PARTITION BY chat_id, run ORDER BY msg_id) AS in_run FROM r) WHERE in_run <= 3""",
    "report_page": _M + "SELECT chat_id, msg_id, date, sender, left(message, 200) AS text FROM m ORDER BY chat_id, msg_id LIMIT 50 OFFSET 50",
    "report_search": _M + "SELECT chat_id, msg_id, date, sender, left(message, 200) AS text FROM m WHERE contains(lower(message), 'night') ORDER BY chat_id, msg_id LIMIT 100",
    "text_masked": _M + f"SELECT * FROM (SELECT chat_id, msg_id, {masked_sql("message")} AS masked, message FROM m) t WHERE masked <> message".replace("SELECT * FROM", "SELECT chat_id, msg_id, masked FROM"),
    "text_quality": _M + f"SELECT chat_id, CASE WHEN message = '' THEN 0.0 WHEN {_BOILER} THEN 0.1 WHEN {_LEN} < 3 THEN 0.5 ELSE 1.0 END::DOUBLE AS quality, count(*) AS n FROM m GROUP BY ALL",
    "text_questions": _TOKENS + f" SELECT chat_id, msg_id FROM tk WHERE contains(message, '?') OR coalesce(tokens[1] IN {_in(ct.INTERROGATIVES)}, false)",
    "text_short_answers": _TOKENS + f""", f AS (SELECT chat_id, msg_id, len(tokens) AS n, coalesce(map_extract_value(MAP {{{", ".join(f"'{k}': '{v}'" for k, v in ct.CANONICAL.items())}}}, tokens[1]), tokens[1]) AS first FROM tk)
SELECT chat_id, msg_id, CASE WHEN first IN {_in(ct.AFFIRMATIVE)} THEN 1 ELSE -1 END AS answer FROM f WHERE n BETWEEN 1 AND 3 AND (first IN {_in(ct.AFFIRMATIVE)} OR first IN {_in(ct.NEGATIVE)})""",
}
_with = lambda name: ORACLES[name]
_NAME = "regexp_extract(trim(sender), '^\\S+')"
_MINUTES = """CASE WHEN {c} < 1 THEN floor({c} * 60 + 0.5)::BIGINT || ' sec' WHEN {c} < 60 THEN floor({c} + 0.5)::BIGINT || ' min' WHEN floor({c} % 60 + 0.5) = 0 THEN floor({c} / 60)::BIGINT || ' hr'
 ELSE floor({c} / 60)::BIGINT || ' hr ' || floor({c} % 60 + 0.5)::BIGINT || ' min' END"""


def _of(name: str, other: tuple[str, str] = ("", "")) -> str:
    """A section, one of its terms replaced, as the table `o`."""
    return f"WITH o AS ({ORACLES[name].replace(*other) if other[0] else ORACLES[name]}) "


ORACLES |= {
    "answer_longer_messages": "SELECT * FROM (" + ORACLES["report_length_by_person"] + ") QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY average_length DESC, sender) = 1",
    "answer_total": _M + "SELECT chat_id, count(*) AS total_messages FROM m GROUP BY ALL",
    "answer_reply_speed": _of("report_response_stats") + f"SELECT chat_id, sender, {_MINUTES.format(c='average_minutes')} AS average FROM o QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY average_minutes, sender) = 1",
    "answer_starter": _of("report_conversation_starters") + "SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY starts DESC, sender) = 1",
    "answer_emoji_user": _of("report_emojis_per_person") + "SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY emojis DESC, sender) = 1",
    "answer_busiest_day": _M + "SELECT chat_id, holder, n::DOUBLE AS value FROM (SELECT chat_id, dayname(ts) AS holder, count(*) AS n, min(msg_id) AS first FROM m WHERE ts IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY n DESC, first) = 1",
    "answer_busiest_hour": _of("report_night_share") + "SELECT chat_id, peak_hour FROM o",
    "answer_top_emoji": _of("report_top_emojis") + "SELECT chat_id, emoji, n FROM o WHERE rank = 1",
    "text_question_types": _M + """SELECT chat_id, CASE WHEN regexp_matches(l, '\\b(?:who|which)[^\\n]*(?:talk|message|text|speak)') THEN 'message_statistics' WHEN regexp_matches(l, 'reply faster|respond faster|response time') THEN 'response_statistics'
 WHEN regexp_matches(l, 'longer messages|long messages|message length') THEN 'message_length_statistics' WHEN regexp_matches(l, 'start[^\\n]*conversation|conversation[^\\n]*start') THEN 'conversation_statistics' ELSE 'conversation_question' END AS kind, count(*) AS n
FROM (SELECT chat_id, lower(trim(message)) AS l FROM m) GROUP BY ALL""",
    "report_word_cloud": _of("report_top_words", ("rank <= 20", "rank <= 24")) + "SELECT chat_id, rank, word, round(n / max(n) OVER (PARTITION BY chat_id), 6) AS scale FROM o",
    "report_month_rhythm": _of("report_by_month") + ", k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY month DESC) <= 12) SELECT chat_id, month, messages, floor(100.0 * messages / max(messages) OVER (PARTITION BY chat_id) + 0.5)::BIGINT AS percent FROM k",
    "report_records": _REPLIES + """, d AS (SELECT chat_id, 'weekday' AS record, dayname(ts) AS holder, count(*) AS n, min(msg_id) AS first FROM m WHERE ts IS NOT NULL GROUP BY ALL UNION ALL SELECT chat_id, 'month', strftime(ts, '%Y-%m'), count(*), min(msg_id) FROM m WHERE ts IS NOT NULL GROUP BY ALL),
v AS (SELECT chat_id, sender, floor(avg(gap_minutes) * 10 + 0.5) / 10.0 AS value FROM a GROUP BY ALL)
SELECT chat_id, record, holder, n::DOUBLE AS value FROM d QUALIFY row_number() OVER (PARTITION BY chat_id, record ORDER BY n DESC, first) = 1
UNION ALL SELECT chat_id, 'fastest_responder', sender, value FROM (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY value, sender) = 1)""",
    "report_tiles": f"""WITH o AS ({_with("report_overview")}), t AS ({_with("report_most_talkative")}), n AS ({_with("report_night_share")}), r AS ({_with("report_response_stats")}), e AS ({_with("report_top_emojis")}), s AS ({_with("report_conversation_starters")})
SELECT chat_id, 'people' AS tile, participants::VARCHAR AS value, 'most messages: ' || {_NAME} AS sub FROM o JOIN t USING (chat_id)
UNION ALL SELECT chat_id, 'days', format('{{:,}}', duration_days), first_date || ' to ' || last_date FROM o WHERE duration_days > 0 UNION ALL SELECT chat_id, 'peak_hour', peak_hour || ' to ' || (peak_hour + 1), NULL FROM n
UNION ALL SELECT chat_id, 'fastest_reply', {_NAME}, {_MINUTES.format(c="average_minutes")} FROM (SELECT * FROM r WHERE average_minutes > 0 QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY average_minutes, sender) = 1)
UNION ALL SELECT chat_id, 'emoji', emoji, format('{{:,}}', n) || ' times' FROM e WHERE rank = 1
UNION ALL SELECT chat_id, 'starter', {_NAME}, 'starts ' || percentage || '% of conversations' FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY starts DESC, sender) = 1)""",
    "report_aliased": f"WITH l AS ({_with('report_length_by_person')}), a AS ({_with('report_aliases')}) SELECT l.* EXCLUDE (sender), a.alias AS sender FROM l JOIN a USING (chat_id, sender)",
    "report_of_sender": _M + "SELECT chat_id, msg_id, sender, message, count(*) OVER () AS total, greatest(1, ceil(count(*) OVER () / 100.0))::BIGINT AS total_pages FROM m WHERE lower(sender) = 'farah' ORDER BY chat_id, msg_id LIMIT 100",
    "report_browse": _M + "SELECT chat_id, msg_id, date, sender, message, (SELECT count(*) FROM m) AS total, 2::BIGINT AS page, ceil((SELECT count(*) FROM m) / 50.0)::BIGINT AS total_pages FROM m ORDER BY chat_id, msg_id LIMIT 50 OFFSET 50",
    "report_browse_search": _M + ", f AS (SELECT * FROM m WHERE contains(lower(message), 'night')) SELECT chat_id, msg_id, date, sender, message, (SELECT count(*) FROM f) AS total, 1::BIGINT AS page, ceil((SELECT count(*) FROM f) / 100.0)::BIGINT AS total_pages FROM f ORDER BY chat_id, msg_id LIMIT 100",
    "report_context": f"""WITH o AS ({_with("report_overview")}), n AS ({_with("report_night_share")}), t AS ({_with("report_most_talkative")})
SELECT o.*, n.night_percent, n.peak_hour, t.sender AS most_talkative FROM o LEFT JOIN n USING (chat_id) LEFT JOIN t USING (chat_id)""",
    "report_persona": f"""WITH t AS ({_with("report_length_by_person")}), n AS ({_with("report_night_share")}), e AS ({_with("report_top_emojis")}), w AS ({_with("report_top_words")}), r AS ({_with("report_response_stats")}), b AS ({_with("report_biggest_day")})
SELECT c.chat_id, c.total_messages, n.night_percent, n.peak_hour, e.emojis, w.words, r.fastest_average, b.messages AS busiest_day FROM (SELECT chat_id, sum(messages)::BIGINT AS total_messages FROM t GROUP BY ALL) c
LEFT JOIN n USING (chat_id) LEFT JOIN (SELECT chat_id, list(emoji ORDER BY rank) AS emojis FROM e WHERE rank <= 5 GROUP BY ALL) e USING (chat_id) LEFT JOIN (SELECT chat_id, list(word ORDER BY rank) AS words FROM w WHERE rank <= 8 GROUP BY ALL) w USING (chat_id)
LEFT JOIN (SELECT chat_id, min(average_minutes) AS fastest_average FROM r WHERE average_minutes > 0 GROUP BY ALL) r USING (chat_id) LEFT JOIN b USING (chat_id)""",
    "report_highlights": f"""WITH o AS ({_with("report_overview")}), n AS ({_with("report_night_share")}), s AS ({_with("report_streaks")}), b AS ({_with("report_biggest_day")}), f AS ({_with("report_fastest_response")}), e AS ({_with("report_top_emojis")}), w AS ({_with("report_top_words")})
SELECT chat_id, 'night_owls' AS statement, night_percent::BIGINT AS value FROM n JOIN o USING (chat_id) WHERE total_messages >= 100 AND night_percent >= 20
UNION ALL SELECT chat_id, 'streak', days::BIGINT FROM s WHERE days >= 7 UNION ALL SELECT chat_id, 'big_day', messages::BIGINT FROM b WHERE messages >= 50
UNION ALL SELECT chat_id, 'quick_reply', floor(gap_minutes * 60 + 0.5)::BIGINT FROM f WHERE floor(gap_minutes * 60 + 0.5) BETWEEN 1 AND 300 UNION ALL SELECT chat_id, 'emoji', n::BIGINT FROM e WHERE rank = 1 AND n >= 50
UNION ALL SELECT chat_id, 'words', total_words::BIGINT FROM w WHERE rank = 1 AND total_words >= 1000 UNION ALL SELECT chat_id, 'span', duration_days::BIGINT FROM o WHERE duration_days >= 30""",
}
