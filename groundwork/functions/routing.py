"""Routers of the question workflow as columns: each gives the name of the next stage."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_RETRIEVALS, MAX_RETRIES = 3, 2


def web_flag(has_docs: Column, sufficient: Column, private: Column) -> Column:
    """Whether retrieval was not enough; never for private questions."""
    return F.when(private, False).when(~has_docs, True).otherwise(~sufficient)


def after_documents(flag: Column, enabled: Column) -> Column:
    return F.when(flag & enabled, "retrieve_missing").otherwise("generate")


def after_missing(retries: Column, sufficient: Column, retrievals: Column, private: Column) -> Column:
    more = F.when(retrievals < MAX_RETRIEVALS, "retrieve_missing").otherwise(F.when(private, "generate").otherwise("web_search"))
    return F.when(retries > 0, "generate").when(sufficient, "generate").otherwise(more)


def after_generation(passed: Column, enabled: Column, attempted: Column, retries: Column, private: Column) -> Column:
    return (
        F.when(passed, "useful").when(~enabled | attempted | private, "end").when(retries < MAX_RETRIES, "retry").otherwise("web_search")
    )


def outcome(attempted: Column, verified: Column) -> Column:
    head = F.when(attempted, "web_search").otherwise("trusted_only")
    return F.concat(head, F.when(verified, "_verified").otherwise("_unverified"))
