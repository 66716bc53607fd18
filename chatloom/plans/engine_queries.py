"""Queries of retrieval, usage and streaming, with the SQL they are compared with."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from chatloom.functions import chattext as ct
from chatloom.operators import evidence, facts, questions, report, retrieval, usage
from chatloom.plans.report_queries import _LEN, _M, _TOKENS, _in, masked_sql
from chatloom.session import scratch_path, table
from chatloom.sources import chatlog
from chatloom.streaming import live

QUESTION = "when does the film club begin?"
TERMS = retrieval.question_terms(QUESTION)


def _m(spark, sf_dir):
    return report.chat_messages(table(spark, sf_dir, "messages"))


def _events(section):
    return lambda spark, sf_dir: section(table(spark, sf_dir, "events"))


def _stream(job, mode):
    return lambda spark, sf_dir: live.run_once(job(live.event_stream(spark, os.path.join(sf_dir, "events.parquet"))), mode)


def _final_totals(spark, sf_dir):
    """The last state of each user."""
    out = live.run_once(live.running_totals(live.event_stream(spark, os.path.join(sf_dir, "events.parquet"))), "update")
    return out.groupBy("user_id").agg(F.max_by("n", "n").alias("n"), F.max_by("total", "n").alias("total"))


def _round_trip(spark, sf_dir):
    """Messages written as text exports, read again and parsed."""
    path = scratch_path(spark, "exports")
    chatlog.write_exports(_m(spark, sf_dir), path)
    parsed = chatlog.parse_lines(chatlog.read_lines(spark, path))
    folder = lambda name: F.regexp_extract("file", f"{name}=(\\d+)", 1).cast("bigint")
    return parsed.select(folder("chat_id").alias("chat_id"), folder("part").alias("part"), "id", "date", "time", "ts", "sender", "message", "message_length", "is_media", "is_deleted")


def _facts(section):
    return lambda spark, sf_dir: section(table(spark, sf_dir, "person_facts"))


def _index(spark, sf_dir):
    return evidence.index(_m(spark, sf_dir))


def _asked(ask):
    """A question over the stored index of all chats."""
    return lambda spark, sf_dir: ask(_index(spark, sf_dir), questions.analyse(spark, QUESTION))


def _reworded(docs, q):
    again = questions.analyse(docs.sparkSession, "film club starts screening")
    return evidence.merged_evidence(evidence.retrieve(docs, q), evidence.retrieve(docs, again)).withColumn("score", F.round("score", 6))


def _lessons(docs, q):
    return evidence.learn(evidence.retrieve(docs, q), docs, q)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _lexical(docs, q):
    """The parts of a score that words alone give, of all messages that hold one of the question's."""
    chats = evidence._of_chat(docs, q, None)
    rows = evidence.counted(docs.filter(F.arrays_overlap("tokens", F.array(*[F.lit(w) for w in q.words]))).join(chats, "chat_id"), q)
    return _rounded(rows.select("chat_id", "msg_id", *[v.cast("double" if k in ("bm25", "stem", "phrase", "proximity", "many") else "int").alias(k) for k, v in evidence.lexical(q).items()]))


def _transcripts(spark, sf_dir):
    rows = table(spark, sf_dir, "messages")
    times = rows.select("row_id", "time")
    return facts.transcript(_m(spark, sf_dir).join(times, "row_id"), 3000)


def _backlog(spark, sf_dir):
    """Documents without a vector, the newest first of each chat, with the text that would be embedded."""
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    rest = docs.join(known, "doc_id", "left_anti").filter(F.col("text").isNotNull())
    newest = report.top(rest, ["chat_id"], [F.desc("created_at"), F.col("doc_id")], 600)
    return newest.select("chat_id", "doc_id", "rank", F.substring(ct.masked(F.col("text")), 1, 300).alias("text"))


QUERIES = {
    "search_retrieved": _asked(lambda d, q: _rounded(evidence.retrieve(d, q))),
    "search_scores": _asked(lambda d, q: _rounded(evidence.choose_pass(evidence.score(d, q), q).drop("asks", "at", "sender"))),
    "search_confidence": _asked(lambda d, q: evidence.confidence(evidence.choose_pass(evidence.score(d, q), q))),
    "search_reworded": _asked(_reworded),
    "search_lessons": _asked(_lessons),
    "search_lexical": _asked(_lexical),
    "search_related_stems": _asked(lambda d, q: _rounded(evidence.related_stems(d, q.topic_stems))),
    "search_negated": _asked(lambda d, q: d.filter(evidence.negated(["film", "photos", "tickets"], F.col("said"))).select("chat_id", "msg_id")),
    "search_soft_terms": lambda s, d: retrieval.soft_terms(retrieval.postings(_m(s, d)), ["kitchn", "potterys", "montain"]),
    "index_senders": _asked(lambda d, q: evidence.sender_postings(d)),
    "index_bigrams": lambda s, d: retrieval.ngram_counts(_m(s, d), 2),
    "index_fingerprints": lambda s, d: retrieval.fingerprints(_m(s, d)),
    "facts_round_trip": lambda s, d: facts.facts_in_documents(facts.chat_document(facts.normalised_facts(table(s, d, "person_facts")))),
    "facts_transcript": _transcripts,
    "embedding_backlog": _backlog,
    "usage_latest_by_key": _events(usage.latest_by_key),
    "usage_votes": _events(usage.votes),
    "usage_since_start": _events(usage.since_start),
    "source_round_trip": _round_trip,
    "facts_normalised": _facts(facts.normalised_facts),
    "facts_documents": _facts(lambda f: facts.to_documents(facts.normalised_facts(f))),
    "facts_of_people": lambda s, d: facts.facts_of_people(table(s, d, "person_facts"), _m(s, d)),
    "index_corpus_stats": lambda s, d: retrieval.corpus_stats(_m(s, d)),
    "index_document_frequency": lambda s, d: retrieval.document_frequency(retrieval.postings(_m(s, d))),
    "index_stem_totals": lambda s, d: retrieval.stem_totals(retrieval.postings(_m(s, d))),
    "index_cooccurrence": lambda s, d: retrieval.cooccurrence(_m(s, d)),
    "search_bm25": lambda s, d: retrieval.bm25(_m(s, d), TERMS).withColumn("score", F.round("score", 6)),
    "search_fuzzy_terms": lambda s, d: retrieval.fuzzy_terms(retrieval.postings(_m(s, d)), ["kitchen", "pottery", "mountain", "balcony"]),
    "search_nearest_vectors": lambda s, d: retrieval.nearest_vectors(table(s, d, "embeddings")),
    "usage_rolling": _events(usage.rolling_usage),
    "usage_over_limit": _events(lambda e: usage.over_limit(e, 1440, 2)),
    "usage_idle_sessions": _events(usage.idle_sessions),
    "usage_visitors": _events(usage.visitors),
    "usage_property_counts": _events(usage.property_counts),
    "usage_newest": _events(usage.newest),
    "stream_tumbling_counts": _stream(live.tumbling_counts, "complete"),
    "stream_first_sightings": _stream(live.first_sightings, "append"),
    "stream_live_sessions": _stream(live.live_sessions, "complete"),
    "stream_running_totals": _final_totals,
}

_CANON = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ct.CANONICAL.items()) + "}"
_MEAN = _TOKENS + f""", mt AS (SELECT chat_id, msg_id, list_filter(list_transform(tokens, lambda t: coalesce(map_extract_value({_CANON}, t), t)), lambda t: length(t) >= 2 AND t NOT IN {_in(ct.LIGHT_STOP_WORDS)}) AS ts FROM tk),
po AS (SELECT chat_id, msg_id, unnest(ts) AS token FROM mt)"""
_IRR = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ct.IRREGULAR.items()) + "}"
_CUT = """CASE WHEN ends_with(token, 'ing') AND length(token) > 5 THEN CASE WHEN regexp_matches(left(token, -3), '(mm|nn|tt|pp)$') THEN left(token, -4) ELSE left(token, -3) END
 WHEN ends_with(token, 'ed') AND length(token) > 4 THEN CASE WHEN ends_with(left(token, -2), 'i') THEN left(token, -3) || 'y' ELSE left(token, -2) END
 WHEN ends_with(token, 'es') AND length(token) > 4 THEN left(token, -2) WHEN ends_with(token, 's') AND NOT ends_with(token, 'ss') THEN left(token, -1)
 WHEN ends_with(token, 'tion') AND length(token) > 6 THEN left(token, -4) WHEN ends_with(token, 'ly') AND length(token) > 4 THEN left(token, -2) ELSE token END"""
_STEM = f"CASE WHEN length(token) <= 3 THEN token ELSE coalesce(map_extract_value({_IRR}, token), CASE WHEN length({_CUT}) >= 2 THEN {_CUT} ELSE token END) END"
_FUZZ = """, v AS (SELECT DISTINCT token FROM po WHERE length(token) >= 4), x AS (SELECT token, unnest(['kitchen', 'pottery', 'mountain', 'balcony']) AS term FROM v),
y AS (SELECT *, levenshtein(regexp_replace(token, '[^\\x00-\\x7F]', '?', 'g'), term) AS dist, greatest(length(token), length(term)) AS longest FROM x)
SELECT token, term, 1 - dist / longest AS similarity FROM y WHERE token <> term AND dist <= CASE WHEN longest <= 5 THEN 1 ELSE 2 END AND 1 - dist / longest >= 0.8"""
_WS = r"[\s\x{A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_TRIM = lambda c: f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"
_FACTS = f"""WITH c AS (SELECT chat_id, trim(person) AS person, fact_id, lower(trim(coalesce(category, ''))) AS category,
  left(trim(regexp_replace(coalesce(fact, ''), '\\s+', ' ', 'g')), 220) AS fact, left({masked_sql("trim(regexp_replace(coalesce(evidence, ''), '\\s+', ' ', 'g'))")}, 140) AS evidence FROM person_facts),
n AS (SELECT chat_id, person, row_number() OVER (PARTITION BY chat_id, person ORDER BY fact_id) AS place, CASE WHEN category IN {_in(facts.KINDS)} THEN category ELSE 'other' END AS category, fact, evidence FROM c WHERE fact <> '')
"""
_Q_WORDS, _Q_STEMS, _Q_TOPIC = ["when", "does", "film", "club", "begin"], ["when", "doe", "film", "club", "begin"], ["film", "club", "begin"]
_BM = "greatest(0.0, ln((docs - {df} + 0.5) / ({df} + 0.5) + 1) * {tf} * 2.4 / ({tf} + 1.4 * (0.25 + 0.75 * greatest(len(ts), 1) / av)))"
_DOCS = _MEAN + f""", st AS (SELECT chat_id, msg_id, ts, list_transform(ts, lambda token: {_STEM}) AS ss FROM mt), sz AS (SELECT chat_id, count(*) AS docs, greatest(1.0, avg(len(ts))) AS av FROM mt GROUP BY chat_id),
pd AS (SELECT chat_id, msg_id, date, row_number() OVER w AS nth, coalesce(date IS NOT DISTINCT FROM lag(date) OVER w AND row_number() OVER w > 1, false) AS same FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY msg_id)),
pr AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY chat_id ORDER BY msg_id) AS run FROM pd)"""
_DULL = _in(sorted({*ct.INTERROGATIVES, *questions.PRONOUNS, *questions.FILLERS, *ct.LIGHT_STOP_WORDS, *_Q_TOPIC}))
ORACLES = {
    "search_lexical": _DOCS + f""", df AS (SELECT chat_id, token, count(DISTINCT msg_id) AS df FROM po WHERE token IN {_in([*_Q_WORDS, *_Q_STEMS])} GROUP BY ALL), dm AS (SELECT chat_id, map(list(token), list(df)) AS dfs FROM df GROUP BY chat_id),
h AS (SELECT chat_id, msg_id, ts, docs, av, lower(t) AS norm, {", ".join(f"len(list_filter(ts, lambda x: x = '{w}')) AS n_{w}, coalesce(map_extract_value(dfs, '{w}'), 1) AS d_{w}, list_position(ts, '{w}') AS p_{w}, len(list_filter(ss, lambda x: x = '{x}')) AS s_{w}, len(list_filter(ts, lambda x: x = '{x}')) AS t_{w}, coalesce(map_extract_value(dfs, '{x}'), 1) AS e_{w}" for w, x in zip(_Q_WORDS, _Q_STEMS, strict=True))}
  FROM st JOIN sz USING (chat_id) JOIN dm USING (chat_id) JOIN nz USING (chat_id, msg_id) WHERE len(list_filter(ts, lambda x: x IN {_in(_Q_WORDS)})) > 0),
p AS (SELECT *, list_filter([{", ".join(f"p_{w}" for w in _Q_WORDS)}], lambda x: x > 0) AS ps FROM h)
SELECT chat_id, msg_id, ({" + ".join(f"(n_{w} > 0)::INT" for w in _Q_WORDS)})::INT AS direct, ({" + ".join(f"(n_{w} > 0)::INT" for w in _Q_TOPIC)})::INT AS direct_topic,
  ({" + ".join(f"CASE WHEN contains(norm, '{x}') THEN {y} ELSE 0.0 END" for x, y in (("when does film", 48.0), ("does film club", 48.0), ("film club begin", 48.0), ("when does", 32.0), ("does film", 32.0), ("film club", 32.0), ("club begin", 32.0)))})::DOUBLE AS phrase,
  round(({" + ".join(f"CASE WHEN n_{w} > 0 THEN {_BM.format(df=f'd_{w}', tf=f'n_{w}')} * {14 if w in _Q_TOPIC else 1.5} ELSE 0 END" for w in _Q_WORDS)})::DOUBLE, 6) AS bm25,
  round(({" + ".join(f"CASE WHEN s_{w} > 0 AND t_{w} = 0 THEN {_BM.format(df=f'e_{w}', tf=f's_{w}')} * {10 if w in _Q_TOPIC else 1.0} ELSE 0 END" for w in _Q_WORDS)})::DOUBLE, 6) AS stem,
  (CASE WHEN len(ps) < 2 THEN 0 WHEN list_max(ps) - list_min(ps) + 1 <= 4 THEN 22 WHEN list_max(ps) - list_min(ps) + 1 <= 8 THEN 14 WHEN list_max(ps) - list_min(ps) + 1 <= 14 THEN 6 ELSE 0 END)::DOUBLE AS proximity,
  (CASE WHEN direct >= 3 THEN 40 WHEN direct >= 2 THEN 16 ELSE 0 END)::DOUBLE AS many FROM p""",
    "search_related_stems": _DOCS + f""", dd AS (SELECT st.chat_id, msg_id, nth, run, ss FROM st JOIN pr USING (chat_id, msg_id)), oc AS (SELECT chat_id, nth, run, unnest(ss) AS stem FROM dd),
nb AS (SELECT DISTINCT d.chat_id, d.nth, o.stem AS related FROM dd d JOIN oc o ON o.chat_id = d.chat_id AND o.run = d.run AND o.nth BETWEEN d.nth - 2 AND d.nth + 2),
cn AS (SELECT o.chat_id, o.stem, nb.related, count(*) AS n FROM oc o JOIN nb USING (chat_id, nth) WHERE o.stem IN {_in(_Q_TOPIC)} AND nb.related NOT IN {_DULL} AND length(nb.related) >= 3 GROUP BY ALL HAVING count(*) >= 2),
sd AS (SELECT chat_id, stem, count(*) AS said FROM oc GROUP BY ALL), hd AS (SELECT chat_id, token, count(DISTINCT msg_id) AS held FROM po GROUP BY ALL)
SELECT chat_id, stem, related, n, round(least(0.65, 0.2 + n * 0.08)::DOUBLE, 6) AS weight FROM (SELECT cn.*, row_number() OVER (PARTITION BY cn.chat_id, cn.stem ORDER BY n DESC, related) AS k FROM cn JOIN sd a ON a.chat_id = cn.chat_id AND a.stem = cn.stem
  JOIN sd b ON b.chat_id = cn.chat_id AND b.stem = cn.related LEFT JOIN hd ON hd.chat_id = cn.chat_id AND hd.token = cn.related JOIN sz ON sz.chat_id = cn.chat_id WHERE n / least(a.said, b.said) >= 0.3 AND coalesce(held, 0) < docs * 0.4) WHERE k <= 6""",
    "search_negated": _TOKENS + f""", tt AS (SELECT chat_id, msg_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS i FROM tk), sm AS (SELECT *, {_STEM} AS stem FROM tt)
SELECT DISTINCT a.chat_id, a.msg_id FROM sm a JOIN sm b ON a.chat_id = b.chat_id AND a.msg_id = b.msg_id AND abs(a.i - b.i) <= 3 WHERE a.token IN {_in(ct.NEGATIONS)} AND (b.token IN ('film', 'photos', 'tickets') OR b.stem IN ('film', 'photos', 'tickets'))""",
    "index_senders": _M + """, w0 AS (SELECT chat_id, string_split(regexp_replace(regexp_replace(regexp_replace(sender, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '[\\x{200B}-\\x{200D}\\x{FEFF}]', '', 'g'), '[‘’]', chr(39), 'g'), '') AS cs FROM m),
w AS (SELECT chat_id, lower(trim(array_to_string(list_filter(cs, lambda x, i: NOT (i > 2 AND x = cs[i - 1] AND x = cs[i - 2])), ''))) AS who, count(*) AS n FROM w0 GROUP BY ALL),
x AS (SELECT chat_id, who, n, unnest(list_concat([who], list_filter(string_split_regex(who, '\\s+'), lambda p: length(p) >= 2 AND p <> who))) AS name FROM w WHERE who <> '') SELECT chat_id, name, sum(n)::BIGINT AS messages FROM x GROUP BY ALL""",
    "index_bigrams": _MEAN + ", b AS (SELECT chat_id, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS gram FROM mt WHERE len(ts) >= 2) SELECT chat_id, gram, count(*) AS n FROM b GROUP BY ALL HAVING count(*) >= 2",
    "facts_round_trip": _FACTS + "SELECT chat_id, person, place::INT AS place, category, fact, evidence FROM n WHERE place <= 5",
    "facts_transcript": _M + """, l AS (SELECT m.chat_id, m.msg_id, '[' || coalesce(m.date, '') || ' ' || coalesce(r.time, '') || '] ' || m.sender || ': ' || trim(regexp_replace(m.message, '[\\s\\p{Z}]+', ' ', 'g')) AS line FROM m JOIN messages r ON r.row_id = m.row_id WHERE trim(regexp_replace(m.message, '[\\s\\p{Z}]+', ' ', 'g')) <> ''),
k AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY msg_id) - 1 AS line_no, sum(length(line) + length(regexp_replace(line, '[^\\x{10000}-\\x{10FFFF}]', '', 'g'))) OVER (PARTITION BY chat_id) + count(*) OVER (PARTITION BY chat_id) - 1 AS size FROM l)
SELECT chat_id, line_no, line FROM k WHERE line_no % CASE WHEN size <= 3000 THEN 1 ELSE ceil(size / 3000.0)::BIGINT END = 0""",
    "embedding_backlog": f"SELECT chat_id, doc_id, rank::INT AS rank, left({masked_sql('text')}, 300) AS text FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at DESC, doc_id) AS rank FROM documents d WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)) WHERE rank <= 600",
    "usage_latest_by_key": "SELECT user_id, event_id, event_type, ts FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 ORDER BY ts DESC, event_id DESC LIMIT 50",
    "usage_votes": "SELECT lower(trim(event_type)) AS name, count(*) FILTER (coalesce(value > 50.0, false)) AS up, count(*) FILTER (NOT coalesce(value > 50.0, false)) AS down FROM events GROUP BY ALL",
    "usage_since_start": "SELECT event_type, count(*) AS n, round(coalesce(sum(value), 0.0), 4) AS total, count(*) FILTER (newest - ts <= INTERVAL 60 SECONDS) AS n_minute FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS newest FROM events WHERE ts IS NOT NULL) GROUP BY ALL",
    "source_round_trip": _M + f""", f AS (SELECT chat_id, msg_id, ts, sender, message FROM m WHERE ts IS NOT NULL AND regexp_full_match(sender, '[^:\\n\\r]{{1,60}}') AND {_TRIM("sender")} <> ''),
l AS (SELECT *, string_split_regex(translate(message, '\u202f\u00a0\u200e\u200f', '    '), '\\r?\\n') AS ls FROM f),
j AS (SELECT chat_id, msg_id, ts, {_TRIM("translate(sender, '\u202f\u00a0\u200e\u200f', '    ')")} AS sender,
  {_TRIM("array_to_string(list_concat([ls[1]], list_filter(list_transform(ls[2:], lambda x: " + _TRIM("x") + "), lambda x: x <> '')), chr(10))")} AS message FROM l)
SELECT chat_id, floor(msg_id / 20000)::BIGINT AS part, row_number() OVER (PARTITION BY chat_id, floor(msg_id / 20000) ORDER BY msg_id) - 1 AS id, strftime(ts, '%d/%m/%Y') AS date, strftime(ts, '%H:%M') AS time, ts,
  sender, message, {_LEN} AS message_length, regexp_matches(message, '(?i)<media omitted>|(?:image|video|audio|sticker|document|gif) omitted') AS is_media, regexp_matches(message, '(?i)this message was deleted|you deleted this message') AS is_deleted
FROM j WHERE message <> ''""",
    "facts_normalised": _FACTS + "SELECT * FROM n WHERE place <= 5",
    "facts_of_people": _M + " SELECT f.chat_id, f.person, count(*) AS facts FROM person_facts f WHERE EXISTS (SELECT 1 FROM m WHERE m.chat_id = f.chat_id AND lower(trim(m.sender)) = lower(trim(f.person))) GROUP BY ALL",
    "index_corpus_stats": _MEAN + " SELECT chat_id, count(*) AS docs, greatest(1.0, avg(len(ts))) AS average_tokens FROM mt GROUP BY chat_id",
    "index_document_frequency": _MEAN + " SELECT chat_id, token, count(DISTINCT msg_id) AS df FROM po GROUP BY ALL",
    "index_stem_totals": _MEAN + f" SELECT chat_id, stem, count(*) AS occurrences FROM (SELECT chat_id, {_STEM} AS stem FROM po) GROUP BY ALL",
    "index_cooccurrence": _MEAN + f""", d0 AS (SELECT chat_id, msg_id, date, row_number() OVER w AS nth, row_number() OVER w > 1 AND date IS NOT DISTINCT FROM lag(date) OVER w AS same FROM m WINDOW w AS (PARTITION BY chat_id ORDER BY msg_id)),
d AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY chat_id ORDER BY msg_id) AS run FROM d0),
st AS (SELECT chat_id, msg_id, {_STEM} AS stem FROM po), o AS (SELECT d.chat_id, d.nth, d.run, stem FROM st JOIN d USING (chat_id, msg_id)),
nb AS (SELECT DISTINCT d.chat_id, d.nth, o.stem AS b FROM d JOIN o ON o.chat_id = d.chat_id AND o.run = d.run AND o.nth BETWEEN d.nth - 2 AND d.nth + 2)
SELECT o.chat_id, o.stem AS a, nb.b, count(*) AS n FROM o JOIN nb USING (chat_id, nth) WHERE o.stem <> nb.b GROUP BY ALL HAVING count(*) >= 2""",
    "search_bm25": _MEAN + f""", s AS (SELECT chat_id, count(*) AS docs, greatest(1.0, avg(len(ts))) AS av FROM mt GROUP BY chat_id), l AS (SELECT chat_id, msg_id, len(ts) AS n FROM mt),
tf AS (SELECT chat_id, msg_id, token, count(*) AS tf FROM po WHERE token IN {_in(TERMS)} GROUP BY ALL), df AS (SELECT chat_id, token, count(*) AS df FROM tf GROUP BY ALL)
SELECT chat_id, msg_id, round(sum(greatest(0.0, ln((docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.4 / (tf + 1.4 * (0.25 + 0.75 * n / av)))), 6) AS score, count(*) AS matched
FROM tf JOIN df USING (chat_id, token) JOIN s USING (chat_id) JOIN l USING (chat_id, msg_id) GROUP BY ALL""",
    "search_fuzzy_terms": _MEAN + _FUZZ,
    "search_nearest_vectors": """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, (list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) + 1) / 2 AS sim
FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 9) DESC, vec_id) AS rank FROM p WHERE sim >= 0.55) WHERE rank <= 10""",
    "usage_rolling": "SELECT event_id, event_type, count(*) OVER w AS n, round(coalesce(sum(value) OVER w, 0.0), 4) AS total FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW)",
    "usage_over_limit": "SELECT user_id, slot, n, n - 2 AS blocked FROM (SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS slot, count(*) AS n FROM events GROUP BY ALL) WHERE n > 2",
    "usage_idle_sessions": """WITH s AS (SELECT user_id, event_id, coalesce(ts - lag(ts) OVER w >= INTERVAL 120 MINUTES, true) AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS session FROM s) SELECT user_id, session, min(event_id) AS first_event, max(event_id) AS last_event, count(*) AS n FROM n GROUP BY ALL""",
    "usage_visitors": "SELECT ts::DATE AS day, count(DISTINCT user_id) AS visitors, count(*) AS events FROM events GROUP BY ALL",
    "usage_property_counts": "SELECT k AS name, json_extract_string(props, '$.' || k) AS value, count(*) AS n FROM (SELECT props, unnest(json_keys(props)) AS k FROM events) GROUP BY ALL",
    "usage_newest": "SELECT event_id, user_id, event_type, left(sha256(user_id::VARCHAR), 16) AS user_hash FROM events ORDER BY ts DESC, event_id DESC LIMIT 500",
    "stream_tumbling_counts": "SELECT time_bucket(INTERVAL 15 MINUTES, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_first_sightings": "SELECT DISTINCT user_id FROM events",
    "stream_live_sessions": """WITH e AS (SELECT user_id, date_trunc('minute', ts) AS t FROM events), s AS (SELECT user_id, t, coalesce(t - lag(t) OVER w >= INTERVAL 120 MINUTES, true) AS starts FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t)),
n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(t)::TIMESTAMP AS start, count(*) AS n FROM n GROUP BY user_id, k""",
    "stream_running_totals": "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
