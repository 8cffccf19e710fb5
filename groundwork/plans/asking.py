"""Requests as a table: limits, validation, shortcuts, the workflow, and the response.

Every gate splits the table; only what is left runs the workflow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import errors, text as tx
from ..operators import limits
from . import flow

#: The answer to what is no question, and to requests before the collections are built.
THANKS = "You're welcome! Ask me anything."
NOT_READY = "Backend not ready. Please try again shortly."
#: Providers that may be asked for; the local one answers in privacy.
PROVIDERS, LOCAL = ("mistral", "gemini", "openai", "ollama"), "ollama"

#: The label of answers with web sources, by language.
LABEL_WITH_WEB = {"en": "Sources incl. web search", "de": "Quellen inkl. Websuche", "da": "Kilder inkl. websøgning"}
#: Fixed value: what a request hears whose model's provider turned it away.
BUSY = "API rate limit exceeded. Please wait about 30 seconds and try again, or switch to Mistral/OpenAI in Settings."


def provider_of(model: Column, keys: Column, default: str = PROVIDERS[0]) -> Column:
    """(provider, key): an unknown model is the default one; the local one has no key."""
    name = F.when(F.lower(model).isin(*PROVIDERS), F.lower(model)).otherwise(default)
    return F.struct(name.alias("provider"), F.when(name != LOCAL, tx.falsy(F.try_element_at(keys, name))).alias("key"))


def gated(requests: DataFrame, *, limit: int = 60, window_s: int = 60, ready: bool = True) -> DataFrame:
    """``requests`` (id, client, micros, question, history, model, api_keys) with the gate that stops
    each, or null: too many, invalid, not ready, small talk, without a key."""
    df = limits.aligned_limit(requests, "client", F.col("micros"), "id", window_s, limit)
    longest = F.reduce(F.map_values("api_keys"), F.lit(""), lambda a, k: F.when(F.length(k) > F.length(a), k).otherwise(a))
    reason = tx.reject_reason(F.col("question"), F.size("history"), longest)
    who = provider_of(F.col("model"), F.col("api_keys"))
    gate = (
        F.when(F.col("status") == 429, "limited").when(reason.isNotNull(), "invalid").when(F.lit(not ready), "not_ready")
        .when(tx.is_small_talk(F.col("question")), "small_talk").when((who["provider"] != LOCAL) & who["key"].isNull(), "no_key")
    )
    return df.withColumns({"gate": gate, "detail": reason, "provider": who["provider"], "privacy_mode": who["provider"] == LOCAL})


def language_label(language: Column) -> Column:
    """The label of answers with web sources; English where a language has none."""
    words = F.create_map(*[F.lit(x) for kv in LABEL_WITH_WEB.items() for x in kv])
    return F.coalesce(F.try_element_at(words, language), F.lit(LABEL_WITH_WEB["en"]))


def answered(requests: DataFrame, models: flow.Models, *, ready: bool = True, language: Callable[[Column], Column] = lambda question: F.lit("en"), trusted_only: bool = False) -> DataFrame:
    """Responses of :func:`gated` requests. Shortcuts do not run the workflow; what is left retrieves,
    searches and asks its models there. A model's failure is a response too: 429 where its provider turned
    the call away, else 500."""
    short = requests.where("gate IS NOT NULL")
    code = F.when(F.col("gate") == "limited", 429).when(F.col("gate").isin("invalid", "no_key"), 400).otherwise(200)
    said = F.when(F.col("gate") == "small_talk", THANKS).when(F.col("gate") == "not_ready", NOT_READY)
    turn = F.array(F.array("question", F.lit(THANKS)))
    past = F.transform("history", lambda h: F.array(h["q"], h["a"]))
    none = F.array().cast("array<struct<source:string,document_type:string>>")
    shortcuts = short.select(
        "id", code.alias("code"), said.alias("answer"), none.alias("sources"), F.when(F.col("gate") == "small_talk", F.concat(past, turn)).otherwise(F.array().cast("array<array<string>>")).alias("chat_history"),
        F.lit(None).cast("string").alias("warning"), F.lit(False).alias("used_web_search"), F.lit(None).cast("string").alias("web_label"), F.lit(None).cast("string").alias("outcome"), "privacy_mode")
    asked = requests.where("gate IS NULL").select("id", "question", "history", F.col("privacy_mode").alias("private"), F.lit(True).alias("web_enabled"))
    done = flow.run_batch(asked, models, ready=ready, trusted_only=trusted_only)
    failed = F.col("error").isNotNull()
    busy = errors.is_rate_limit(F.col("error"))
    cited = F.array_distinct(F.zip_with("documents.source", "documents.document_type", lambda s, kind: F.struct(F.coalesce(s, F.lit("retrieved")).alias("source"), kind.alias("document_type"))))
    told = F.concat(F.transform("history", lambda h: F.array(h["q"], h["a"])), F.array(F.array("question", "generation")))
    full = done.select(
        "id", F.when(~failed, 200).when(busy, 429).otherwise(500).alias("code"), F.when(~failed, F.col("generation")).when(busy, BUSY).otherwise(F.col("error")).alias("answer"),
        F.when(failed, none).otherwise(cited).alias("sources"), F.when(failed, F.array().cast("array<array<string>>")).otherwise(told).alias("chat_history"), "warning",
        F.col("attempted").alias("used_web_search"), F.when(F.col("attempted"), language_label(language(F.col("question")))).alias("web_label"), "outcome", F.col("private").alias("privacy_mode"))
    return shortcuts.unionByName(full)


def answer_counters(responses: DataFrame) -> DataFrame:
    """(name, label, value): questions with a web search, and questions by outcome, of :func:`answered`."""
    web = responses.agg(F.count_if("used_web_search").alias("value")).select(F.lit("query_web_search_attempts").alias("name"), F.lit("").alias("label"), "value")
    by = responses.where("outcome IS NOT NULL").groupBy("outcome").count()
    return web.unionByName(by.select(F.lit("query_outcomes_total").alias("name"), F.col("outcome").alias("label"), F.col("count").alias("value")))
