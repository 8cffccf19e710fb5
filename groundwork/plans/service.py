"""Queries: conversations, requests, limits, routing, evaluation, streams."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import routing as rt, text as tx
from ..operators import containment, evals, language, limits
from ..operators.tables import written
from ..streaming import streams
from . import asking, flow
from .tables import t


def _pairs(spark, sf_dir):
    """User turns with the assistant turn right after them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = t(spark, sf_dir, "conversations").withColumns({"next_role": F.lead("role").over(w), "a": F.lead("text").over(w)})
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("q"), "a")


def history_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


def _histories(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    h = F.array_sort(F.collect_list(F.struct("turn", "q", "a")))
    return p.groupBy("conv_id").agg(F.transform(h, lambda x: F.struct(x["q"].alias("q"), x["a"].alias("a"))).alias("h"))


def history_last_exchange(spark, sf_dir):
    last = F.element_at("h", -1)
    return _histories(spark, sf_dir).select("conv_id", last["q"].alias("q"), last["a"].alias("a"))


def history_prefix(spark, sf_dir):
    h = _histories(spark, sf_dir)
    return h.select("conv_id", tx.exchange_prefix(F.col("h"), 400).alias("prefix"), tx.follow_up_query(F.lit("And then?"), F.col("h")).alias("query"))


def history_render(spark, sf_dir):
    return _histories(spark, sf_dir).select("conv_id", tx.history_text(F.col("h")).alias("history"))


def non_question_gate(spark, sf_dir):
    """The gate on every turn."""
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", tx.is_small_talk(F.col("text")).alias("small_talk"))


def input_limits(spark, sf_dir):
    c = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("question"), F.count("*").alias("turns"))
    long = F.repeat("question", F.lit(40))
    return c.select("conv_id", tx.reject_reason(F.when(F.col("conv_id") % 2 == 0, long).otherwise(F.col("question")), F.col("turns") * 3, F.lit("k")).alias("reason"))


STOP_WORDS = {"en": ("the", "of", "and", "is"), "fr": ("le", "de", "et", "un"), "de": ("der", "und", "die", "ist"), "es": ("el", "los", "para", "una")}


def lang_fallback_message(spark, sf_dir):
    """The label in the language of each document, English where it has none."""
    return t(spark, sf_dir, "documents").select("doc_id", asking.language_label(F.col("lang")).alias("message"))


def lang_detect_stopwords(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", tx.stop_word_language(F.col("text"), STOP_WORDS).alias("lang"))


def lang_profiles(spark, sf_dir):
    """The language of each document by profiles learned from four fifths of the labels; every fifth row is
    held out."""
    d = t(spark, sf_dir, "documents")
    known = written(language.profiles(d.where("doc_id % 5 <> 0")), "profiles")
    got = language.detected(d, known, "doc_id").withColumnRenamed("lang", "lang_pred")
    return got.select("doc_id", (F.col("doc_id") % 5 == 0).alias("held_out"), "lang_pred")


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def rate_limit_aligned(spark, sf_dir):
    e = limits.aligned_limit(t(spark, sf_dir, "events"), "user_id", _micros(), "event_id", 86_400, 3)
    return e.select("event_id", "n_in_window", "status", "retry_after")


def rate_limit_anchored(spark, sf_dir):
    e = limits.anchored_limit(t(spark, sf_dir, "events"), "user_id", _micros(), "event_id", 86_400, 3)
    return e.select("event_id", "n_in_window", "status", "retry_after")


def _requests(spark, sf_dir):
    return t(spark, sf_dir, "events").withColumn("code", F.when(F.col("event_type") == "error", 500).otherwise(200))


def request_counters(spark, sf_dir):
    r = _requests(spark, sf_dir).groupBy(F.col("event_type").alias("path"))
    return r.agg(F.count("*").alias("requests"), F.count_if(F.col("code") >= 400).alias("errors"), F.round(F.sum("value"), 4).alias("duration"))


def status_class_counters(spark, sf_dir):
    return _requests(spark, sf_dir).groupBy(tx.status_class(F.col("code")).alias("status")).agg(F.count("*").alias("requests"))


def metrics_exposition(spark, sf_dir):
    return limits.exposition(request_counters(spark, sf_dir), "requests_total", "path", "requests").select("line")


def client_keys(spark, sf_dir):
    """Clients by forwarding header, then host."""
    e = t(spark, sf_dir, "events")
    hop = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" , 1.1.1.1"))).when(F.col("event_id") % 3 == 1, F.lit(" "))
    host = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("h"), F.col("user_id").cast("string")))
    return e.groupBy(tx.client_key(hop, host).alias("client")).agg(F.count("*").alias("n"))


def _flags(spark, sf_dir):
    l = t(spark, sf_dir, "labels")
    return l.select(
        "doc_id", (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"), (F.col("doc_id") % 2 == 0).alias("on"),
        (F.col("doc_id") % 3 == 0).alias("tried"), (F.col("doc_id") % 4).cast("int").alias("n"), (F.col("doc_id") % 5 == 0).alias("private"),
    )


def route_after_docs(spark, sf_dir):
    flag = rt.web_flag(~F.col("tried"), F.col("good"), F.col("private"))
    return _flags(spark, sf_dir).select("doc_id", rt.after_documents(flag, F.col("on")).alias("next"))


def route_after_missing(spark, sf_dir):
    return _flags(spark, sf_dir).select("doc_id", rt.after_missing(F.col("n") - 2, F.col("good"), F.col("n") + 1, F.lit(False)).alias("next"))


def route_after_generation(spark, sf_dir):
    nxt = rt.after_generation(F.col("good"), F.col("on"), F.col("tried"), F.col("n"), F.lit(False))
    return _flags(spark, sf_dir).select("doc_id", nxt.alias("next"))


def outcome_matrix(spark, sf_dir):
    f = _flags(spark, sf_dir)
    return f.groupBy(rt.outcome(F.col("tried"), ~F.col("toxic")).alias("outcome")).agg(F.count("*").alias("n"))


def pipeline_outcomes(spark, sf_dir):
    """The whole workflow: every labelled document as a question over its own text, with graders
    that follow its labels and its number."""
    f = _flags(spark, sf_dir).groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("good", "toxic", "on", "private")])
    d = t(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang").join(f, "doc_id")
    tag = F.concat_ws(":", F.lit("#"), F.col("good").cast("int"), F.col("toxic").cast("int"), F.col("doc_id") % 7)
    q = d.select(
        F.col("doc_id").alias("id"), tag.alias("question"), F.array().cast("array<struct<q:string,a:string>>").alias("history"), "private", F.col("on").alias("web_enabled"))
    own = d.where("doc_id % 11 > 0").select(F.col("doc_id").alias("id"), F.lit(1).alias("ord"), "text", "source", F.col("lang").alias("document_type"))
    web = d.select(F.col("doc_id").alias("id"), F.lit(1).alias("ord"), F.lit("found").alias("text"), F.lit("web").alias("source"), F.lit("web").alias("document_type"))
    part = lambda c, i: F.element_at(F.split(c, ":"), i)
    models = flow.Models(
        retrieve=flow.table_search(own), search=flow.table_search(web), missing_query=flow.hinted_question(), search_query=flow.question_alone(),
        sufficient=flow.by_column(lambda question, context: part(question, 2) == "1", native=True),
        generate=flow.by_column(lambda question, context, history, retries: F.concat_ws(":", question, retries.cast("string")), native=True),
        grade=flow.by_column(lambda question, context, g: F.struct((part(g, 5).cast("int") >= part(g, 4).cast("int") - 1).alias("passed"), F.lit("").alias("missing_info")), native=True),
        grounded=flow.by_column(lambda context, g: part(g, 3) == "0", native=True),
    )
    return flow.run_batch(q, models).select("id", "generations", "retrievals", "retries", "attempted", "verified", "warning", "outcome")


def eval_precision_at_k(spark, sf_dir):
    """Quality labels of each block of ten documents as verdicts."""
    l = t(spark, sf_dir, "labels").groupBy(F.floor(F.col("doc_id") / 10).alias("item"))
    v = l.agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "quality"))), lambda x: x["quality"]).alias("v"))
    return v.select("item", F.round(evals.precision_at(F.col("v")), 6).alias("precision"))


def eval_context_recall(spark, sf_dir):
    """The words of each benchmark passage as facts, its first half as the context."""
    b = t(spark, sf_dir, "benchmark")
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    return b.select("item_id", F.round(evals.fact_recall(half, F.split("text", " ")), 6).alias("recall"))


def _metrics(spark, sf_dir):
    l = t(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 50).alias("item"))
    return l.agg(F.avg("quality").alias("recall"), (1 - F.avg("toxic")).alias("faithfulness"))


def eval_pass_rule(spark, sf_dir):
    m = F.create_map(F.lit("recall"), F.col("recall"), F.lit("faithfulness"), F.col("faithfulness"))
    return _metrics(spark, sf_dir).select("item", evals.passes(m).alias("all_pass"), evals.passes(m, "mean", 0.87).alias("mean_pass"))


def eval_summary(spark, sf_dir):
    m = _metrics(spark, sf_dir).withColumn("pass", (F.col("recall") >= 0.85) & (F.col("faithfulness") >= 0.85))
    s = evals.summary(m, ["recall", "faithfulness"])
    return s.select(*[F.round(c, 6).alias(c) for c in ("mean_recall", "mean_faithfulness", "pass_rate")], "n")


def fact_containment_join(spark, sf_dir):
    """Documents that hold a benchmark passage whole, at any offset."""
    b = t(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("fact"))
    d = t(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("low"))
    return containment.holding(d, b, "doc_id", "low", "item_id", "fact")


def stream_counters(spark, sf_dir):
    return streams.run_available(streams.counters(streams.events(spark, sf_dir)), ("event_type",)).select("event_type", "n", "total")


def stream_windows(spark, sf_dir):
    return streams.run_available(streams.windowed(streams.events(spark, sf_dir)), ("start", "event_type")).select("start", "event_type", "n")


def stream_rate_limit(spark, sf_dir):
    return streams.run_anchored(streams.events(spark, sf_dir), 86_400, 3).select("event_id", "n_in_window", "status")


def stream_harvest_dedupe(spark, sf_dir):
    return streams.run_available(streams.deduped(streams.events(spark, sf_dir))).select("identifier", "day")


QUERIES = {f.__name__: f for f in (
    history_pairs, history_last_exchange, history_prefix, history_render, non_question_gate, input_limits, lang_fallback_message, lang_detect_stopwords,
    rate_limit_aligned, rate_limit_anchored, request_counters, status_class_counters, metrics_exposition, client_keys, route_after_docs,
    route_after_missing, route_after_generation, outcome_matrix, pipeline_outcomes, eval_precision_at_k, eval_context_recall, eval_pass_rule,
    eval_summary, lang_profiles, fact_containment_join, stream_counters, stream_windows, stream_rate_limit, stream_harvest_dedupe,
)}

_P = """l AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, text AS q, a FROM l WHERE role = 'user' AND nr = 'assistant')"""
_X = "arg_max(q, turn) AS q, arg_max(a, turn) AS a"
_CUT = lambda n: f"CASE WHEN length(a) > {n} THEN left(a, {n}) || '…' ELSE a END"
_F = """f AS (SELECT doc_id, quality = 1 AS good, toxic = 1 AS toxic, doc_id % 2 = 0 AS o, doc_id % 3 = 0 AS tried, doc_id % 4 AS n, doc_id % 5 = 0 AS private FROM labels)"""
_E = "e AS (SELECT *, epoch_us(ts) AS m FROM events)"
_ANCHORED = f"""WITH RECURSIVE {_E}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m, event_id) AS i FROM e),
r AS (SELECT user_id, event_id, i, m, m AS start, 1 AS n FROM s WHERE i = 1
  UNION ALL SELECT s.user_id, s.event_id, s.i, s.m, CASE WHEN s.m - start >= 86400000000 THEN s.m ELSE start END, CASE WHEN s.m - start >= 86400000000 THEN 1 ELSE n + 1 END
  FROM r JOIN s ON s.user_id = r.user_id AND s.i = r.i + 1)"""
_WORDS = " ".join(
    f"list_count(list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda x: x IN ({', '.join(repr(w) for w in ws)})))::BIGINT AS {lang}," for lang, ws in STOP_WORDS.items()
)

ORACLE = {
    "history_pairs": f"WITH {_P} SELECT conv_id, turn, q, a FROM p",
    "history_last_exchange": f"WITH {_P} SELECT conv_id, {_X} FROM p GROUP BY 1",
    "history_prefix": f"""WITH {_P}, x AS (SELECT conv_id, {_X} FROM p GROUP BY 1)
SELECT conv_id, 'Previous exchange:' || chr(10) || 'User: ' || q || chr(10) || 'Assistant: ' || {_CUT(400)} || chr(10) || chr(10) AS prefix,
  'Previous: ' || q || '. Assistant: ' || {_CUT(300)} || '. Current question: And then?' AS query FROM x""",
    "history_render": f"WITH {_P} SELECT conv_id, string_agg('User: ' || q || chr(10) || 'Assistant: ' || a, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) AS history FROM p GROUP BY 1",
    "non_question_gate": f"""SELECT conv_id, turn, length(w) < 3 OR w IN ({', '.join(repr(x) for x in tx.SMALL_TALK)}) OR NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]') AS small_talk
FROM (SELECT conv_id, turn, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS w FROM conversations)""",
    "input_limits": """SELECT conv_id, CASE WHEN len > 10000 THEN 'question too long' WHEN n * 3 > 20 THEN 'history too long' END AS reason FROM (
  SELECT conv_id, length(arg_max(text, turn)) * CASE WHEN conv_id % 2 = 0 THEN 40 ELSE 1 END AS len, count(*) AS n FROM conversations GROUP BY conv_id)""",
    "lang_fallback_message": "SELECT doc_id, CASE lang WHEN 'de' THEN 'Quellen inkl. Websuche' WHEN 'da' THEN 'Kilder inkl. websøgning' ELSE 'Sources incl. web search' END AS message FROM documents",
    "lang_detect_stopwords": f"""WITH c AS (SELECT doc_id, text, {_WORDS} FROM documents)
SELECT doc_id, CASE WHEN length(trim(text)) < 3 OR greatest(en, fr, de, es) = 0 OR en = greatest(en, fr, de, es) THEN 'en'
  WHEN fr = greatest(en, fr, de, es) THEN 'fr' WHEN de = greatest(en, fr, de, es) THEN 'de' ELSE 'es' END AS lang FROM c""",
    "lang_profiles": r"""WITH t AS (SELECT doc_id, lang, string_split(' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ', '') AS c FROM documents),
g AS (SELECT doc_id, lang, unnest([c[i] || c[i + 1] || c[i + 2] FOR i IN range(1, len(c) - 1)]) AS gram FROM t),
k AS (SELECT lang, gram, 301 - row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, encode(gram)) AS points FROM g WHERE doc_id % 5 <> 0 AND lang IS NOT NULL GROUP BY 1, 2 QUALIFY points > 0),
s AS (SELECT g.doc_id, k.lang, sum(points) AS n FROM g JOIN k USING (gram) GROUP BY 1, 2),
b AS (SELECT doc_id, lang FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) = 1)
SELECT doc_id, doc_id % 5 = 0 AS held_out, coalesce(b.lang, 'en') AS lang_pred FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN b USING (doc_id)""",
    "rate_limit_aligned": f"""WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id, m // 86400000000 ORDER BY m, event_id)::INT AS n_in_window FROM e)
SELECT event_id, n_in_window, CASE WHEN n_in_window > 3 THEN 429 ELSE 200 END AS status, CASE WHEN n_in_window > 3 THEN (86400 - (m // 1000000) % 86400)::INT END AS retry_after FROM n""",
    "rate_limit_anchored": f"""{_ANCHORED} SELECT event_id, n AS n_in_window, CASE WHEN n > 3 THEN 429 ELSE 200 END AS status,
  CASE WHEN n > 3 THEN greatest(1, (86400000000 - (m - start)) // 1000000)::INT END AS retry_after FROM r""",
    "request_counters": "SELECT event_type AS path, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS duration FROM events GROUP BY 1",
    "status_class_counters": "SELECT CASE WHEN event_type = 'error' THEN '5xx' ELSE '2xx' END AS status, count(*) AS requests FROM events GROUP BY 1",
    "metrics_exposition": """SELECT 'requests_total{path="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "client_keys": """SELECT CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (user_id % 250) WHEN event_id % 2 = 0 THEN 'h' || user_id ELSE 'unknown' END AS client, count(*) AS n
FROM events GROUP BY 1""",
    "route_after_docs": f"""WITH {_F} SELECT doc_id, CASE WHEN NOT private AND (tried OR NOT good) AND o THEN 'retrieve_missing' ELSE 'generate' END AS next FROM f""",
    "route_after_missing": f"""WITH {_F} SELECT doc_id, CASE WHEN n > 2 OR good THEN 'generate' WHEN n + 1 < 3 THEN 'retrieve_missing' ELSE 'web_search' END AS next FROM f""",
    "route_after_generation": f"""WITH {_F} SELECT doc_id, CASE WHEN good THEN 'useful' WHEN NOT o OR tried THEN 'end' WHEN n < 2 THEN 'retry' ELSE 'web_search' END AS next FROM f""",
    "outcome_matrix": f"""WITH {_F} SELECT CASE WHEN tried THEN 'web_search' ELSE 'trusted_only' END || CASE WHEN toxic THEN '_unverified' ELSE '_verified' END AS outcome, count(*) AS n FROM f GROUP BY 1""",
    "pipeline_outcomes": """WITH f AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic, doc_id % 2 = 0 AS o, doc_id % 5 = 0 AS private, greatest(0, doc_id % 7 - 1) AS need, doc_id % 11 > 0 AS docs
  FROM labels WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY doc_id),
w AS (SELECT *, o AND NOT private AS wide, o AND NOT private AND NOT (good AND docs) AS early, o AND NOT private AND good AND docs AND need > 2 AS late FROM f),
v AS (SELECT *, early OR late AS attempted, docs AND NOT toxic AS verified FROM w)
SELECT doc_id AS id, (CASE WHEN late THEN 4 WHEN wide AND NOT early THEN need + 1 ELSE 1 END)::INTEGER AS generations, CASE WHEN early THEN 3 ELSE 1 END AS retrievals,
  (CASE WHEN late THEN 2 WHEN wide AND NOT early THEN need ELSE 0 END)::INTEGER AS retries, attempted, verified,
  CASE WHEN NOT docs THEN 'no_trusted_sources' WHEN verified THEN NULL WHEN attempted THEN 'not_verified_after_web' ELSE 'not_verified_trusted_only' END AS warning,
  CASE WHEN attempted THEN 'web_search' ELSE 'trusted_only' END || CASE WHEN verified THEN '_verified' ELSE '_unverified' END AS outcome FROM v""",
    "eval_precision_at_k": """WITH v AS (SELECT doc_id // 10 AS item, list(quality ORDER BY doc_id) AS v FROM labels GROUP BY 1),
p AS (SELECT item, [list_sum(v[1:k])::DOUBLE / k FOR k IN [1, 3, 5] IF k <= len(v)] AS ps FROM v)
SELECT item, round(list_sum(ps) / len(ps), 6) AS precision FROM p""",
    "eval_context_recall": """WITH b AS (SELECT item_id, lower(left(text, length(text) // 2)) AS c, string_split(text, ' ') AS fs FROM benchmark)
SELECT item_id, round(len([x FOR x IN fs IF contains(c, lower(x))])::DOUBLE / len(fs), 6) AS recall FROM b""",
    "eval_pass_rule": """WITH m AS (SELECT doc_id % 50 AS item, avg(quality) AS r, 1 - avg(toxic) AS f FROM labels GROUP BY 1)
SELECT item, r >= 0.5 AND f >= 0.5 AS all_pass, (r + f) / 2 >= 0.87 AS mean_pass FROM m""",
    "eval_summary": """WITH m AS (SELECT doc_id % 50 AS item, avg(quality) AS r, 1 - avg(toxic) AS f FROM labels GROUP BY 1)
SELECT round(avg(r), 6) AS mean_recall, round(avg(f), 6) AS mean_faithfulness, round(avg((r >= 0.85 AND f >= 0.85)::INT), 6) AS pass_rate, count(*) AS n FROM m""",
    "fact_containment_join": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))",
    "stream_counters": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "stream_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_rate_limit": f"{_ANCHORED} SELECT event_id, n AS n_in_window, CASE WHEN n > 3 THEN 429 ELSE 200 END AS status FROM r",
    "stream_harvest_dedupe": "SELECT DISTINCT event_type || '-' || user_id AS identifier, strftime(ts, '%Y-%m-%d') AS day FROM events",
}
