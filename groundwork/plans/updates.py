"""Version resolution: candidates by priority, recency, status rows, synchronisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import versions as vs, web
from ..operators.registry import upsert
from ..operators.tables import once


def first_accepted(candidates: DataFrame, *, reject_older: bool = True) -> DataFrame:
    """(id, label, url) of the best-placed candidate: id, priority, label, url, current_url,
    current_version. Candidates that are not newer are passed over, but for the last resort,
    whose priority is null."""
    df = candidates.where("url IS NOT NULL")
    if reject_older:
        df = once(df, remote=vs.label_date_nr(F.col("label")), ours=vs.label_date_nr(F.col("current_version")), remote_yn=vs.url_year_nr(F.col("url")), url_yn=vs.url_year_nr(F.col("current_url")), label_yn=vs.label_year_nr(F.col("current_version")))
        late = vs.not_newer(F.col("url"), F.col("remote"), F.col("ours"), F.col("remote_yn"), F.greatest("url_yn", "label_yn"))
        df = df.where(F.col("priority").isNull() | ~late)
    best = F.min_by(F.struct("label", "url"), F.coalesce("priority", F.lit(1 << 30)))
    return df.groupBy("id").agg(best.alias("b")).select("id", "b.label", "b.url")


def best_hits(hits: DataFrame) -> DataFrame:
    """(id, url): of a search's hits (id, ord, title, url, wanted) those that fit and are current,
    the latest by date and number, of equal ones the first."""
    label_date, yn = F.col("dated_at"), F.col("yn")
    fits = web.title_fits(F.col("title"), F.col("wanted")) & ~web.is_archived(F.col("title"), F.col("url"))
    rank = F.struct(
        label_date.isNotNull().alias("dated"), F.coalesce(label_date, F.lit("0001-01-01").cast("date")).alias("d"),
        F.coalesce(yn["year"], F.lit(0)).alias("y"), F.coalesce(yn["nr"], F.lit(0)).alias("n"), (-F.col("ord")).alias("o"),
    )
    read = once(hits.where(fits), dated_at=vs.label_date(F.col("title")), yn=vs.url_year_nr(F.col("url")))
    return read.where("yn IS NOT NULL").withColumn("rank", rank).groupBy("id").agg(F.max_by("url", "rank").alias("url"))


def first_pdf(hits: DataFrame, site: str = "sst.dk") -> DataFrame:
    """(id, url): the first PDF of a site, else its first hit."""
    own = hits.where(F.contains(F.lower("url"), F.lit(site)))
    full = F.when(F.startswith("url", F.lit("http")), F.col("url")).otherwise(F.concat(F.lit("https://"), F.ltrim("url", F.lit("/"))))
    pick = F.struct((~F.contains(F.lower("url"), F.lit(".pdf"))).alias("later"), F.col("ord"))
    return own.withColumn("pick", pick).withColumn("url", full).groupBy("id").agg(F.min_by("url", "pick").alias("url"))


def first_queries(queries: DataFrame, results: DataFrame, n: int = 3) -> DataFrame:
    """(id, url): the first of the first ``n`` non-blank queries (id, ord, query) that a result
    answers (query, url)."""
    rows = queries.where((F.col("ord") < n) & (F.trim("query") != "")).join(results, "query")
    return rows.where("url IS NOT NULL").groupBy("id").agg(F.min_by("url", "ord").alias("url"))


def arbitrate(mode: Column, graph_url: Column) -> Column:
    """Which resolver's answer holds: the graph's, or that of the older chain."""
    found = F.coalesce(graph_url, F.lit("")) != ""
    return F.when(mode.isin("guarded", "enforce"), F.when(found, "graph").otherwise("legacy")).when(mode == "shadow", "legacy").otherwise(
        F.when(found, "graph").otherwise("legacy"))


def check_updates(sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """Status rows. ``sources``: id, name, url, folder, current_version; ``resolved``: id, label,
    url, error."""
    r = resolved.select("id", F.col("label").alias("remote_version"), F.col("url").alias("download_url"), "error")
    df = sources.join(r, "id", "left")
    newer = vs.update_available(F.col("current_version"), F.col("remote_version"), F.col("url"), F.col("download_url"))
    local_only = F.coalesce("url", F.lit("")) == ""
    return df.select(
        "id", "name", "url", "folder", "current_version", F.when(local_only, "Local only").when(F.col("error").isNull(), F.col("remote_version")).alias("remote_version"),
        F.when(local_only | F.col("error").isNotNull() | F.col("download_url").isNull(), False).otherwise(newer).alias("update_available"),
        vs.label_date(F.col("current_version")).alias("local_date"), vs.label_date(F.col("remote_version")).alias("remote_date"), "download_url", "error",
    )


def sync(state: DataFrame, status: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(new state, report): changed sources take their remote version; the older-edition filter
    has held before."""
    changed = status.where("update_available AND remote_version IS NOT NULL")
    new = upsert(state, changed.select("id", F.col("remote_version").alias("version"), today.alias("updated_at")), "id", "updated_at")
    kind = F.when(F.col("error").isNotNull() | F.col("download_url").isNull(), "unresolved").when(F.col("update_available"), "changed").otherwise("unchanged")
    report = status.withColumn("kind", kind).agg(F.count("*").alias("checked"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("changed", "unchanged", "unresolved")])
    return new, report
