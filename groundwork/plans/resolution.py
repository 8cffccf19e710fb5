"""Resolution of newer editions: one plan over all sources, instead of a walk for each.

Every way of finding an edition gives candidate rows with a priority; rejected candidates are left
out and the best-placed one is chosen by one aggregate. Pages and search hits are tables that a crawl
has left. Tables: ``sources`` (id, name, url, folder, current_version), hits (id, ord, title, url),
``pages`` (url, html), ``editions`` (nr, year, label, url)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import versions as vs, web
from ..functions.text import falsy, strip
from ..operators.tables import once, written
from . import updates

#: The folders of the two families of sources.
LAW, AGENCY = "Bekendtgørelse", ("IAEA", "IAEA_other")
MANUAL = "Manual check required"
UNKNOWN = "Cannot detect newest"
LOCAL = "Local only (no URL)"


def read_pages(pages: DataFrame) -> DataFrame:
    """What pages (url, html) say, a written table, so that each is read once: new_label and new_url of
    their newest amendment, over_title and over_url of what supersedes them."""
    if "new_url" in pages.columns:
        return pages
    df = once(web.with_newest_amendment(pages.select("url", "html"), once), over=web.superseded_by(F.col("html")))
    return written(df.select(
        "url", F.col("n.label").alias("new_label"), F.col("n.url").alias("new_url"), F.col("over.title").alias("over_title"), F.col("over.url").alias("over_url"),
        F.col("html").isNotNull().alias("there")), "pages-read")


def newest_of(found: DataFrame, pages: DataFrame) -> DataFrame:
    """``found`` (id, url) with label and newest url of the page's list of amendments, null without.
    ``pages`` as :func:`read_pages` gives them."""
    asked = found.where(web.is_law_site(F.col("url")))
    known = pages.where("new_url IS NOT NULL").select("url", "new_label", "new_url")
    return asked.join(known, "url").select("id", "url", "new_label", "new_url")


def followed(found: DataFrame, pages: DataFrame, label: Column | None = None) -> DataFrame:
    """(id, label, url): what a found page says is newest, else the found page itself, under
    ``label`` or as a search result."""
    nr = F.coalesce(vs.url_year_nr(F.col("url"))["nr"].cast("string"), F.lit("?"))
    plain = F.concat(F.lit("BEK nr "), nr, F.lit(" (search)")) if label is None else label
    df = found.join(newest_of(found, pages), ["id", "url"], "left")
    return df.select("id", F.coalesce("new_label", plain).alias("label"), F.coalesce("new_url", "url").alias("url"))


def probed(wanted: DataFrame, editions: DataFrame) -> DataFrame:
    """(id, label, url): the latest edition of a number. ``wanted``: id, nr."""
    best = editions.groupBy("nr").agg(F.max_by(F.struct("label", "url"), "year").alias("b"))
    return wanted.join(best, "nr").select("id", "b.label", "b.url")


def law_chain(
    sources: DataFrame, title_hits: DataFrame, pages: DataFrame, editions: DataFrame, *, site_hits: DataFrame | None = None,
    number_hits: DataFrame | None = None, reject_older: bool = True,
) -> DataFrame:
    """(id, label, url): guidance sites by search, then titles, then the number by probing, then, for
    sources without a name, the number by search, and last the source's own page."""
    pages = read_pages(pages)
    held = sources.select("id", F.col("url").alias("current_url"), "current_version", "name")
    named = strip(F.coalesce("name", F.lit(""))) != ""
    wanted = held.select("id", F.coalesce("name", F.lit("")).alias("wanted"), named.alias("named"))
    by_title = updates.best_hits(title_hits.join(wanted.where("named"), "id"))
    number = vs.decree_number(F.col("url"), F.col("current_version"), F.lit(None).cast("string"), F.col("name"), F.col("id").cast("string"))
    numbers = once(sources.select("id", "url", "current_version", "name"), nr=number).select("id", "nr").where("nr IS NOT NULL")
    found = probed(numbers, editions)
    rows = [followed(by_title, pages).withColumn("priority", F.lit(2)), followed(found, pages, F.col("label")).withColumn("priority", F.lit(3))]
    if site_hits is not None:
        guidance = sources.where(web.is_guidance(F.col("url"), F.col("name"))).select("id", "name")
        first = updates.first_pdf(site_hits.join(guidance, "id", "left_semi")).join(guidance, "id")
        rows.append(first.select("id", F.coalesce(falsy(F.col("name")), F.lit("guidance")).alias("label"), "url", F.lit(1).alias("priority")))
    if number_hits is not None:
        by_number = updates.best_hits(number_hits.join(wanted.where("NOT named"), "id").join(numbers, "id", "left_semi"))
        again = probed(by_number.select("id", vs.url_year_nr(F.col("url"))["nr"].alias("nr")), editions)
        newest = newest_of(by_number, pages).select("id", F.col("new_label").alias("label"), F.col("new_url").alias("url"), F.lit(40).alias("priority"))
        rows += [newest, again.withColumn("priority", F.lit(41)), followed(by_number, pages).withColumn("priority", F.lit(42))]
    own = newest_of(sources.select("id", "url"), pages)
    rows.append(own.select("id", F.col("new_label").alias("label"), F.col("new_url").alias("url"), F.lit(None).cast("int").alias("priority")))
    candidates = rows[0].select("id", "label", "url", "priority")
    for r in rows[1:]:
        candidates = candidates.unionByName(r.select("id", "label", "url", "priority"))
    return updates.first_accepted(candidates.join(held.select("id", "current_url", "current_version"), "id"), reject_older=reject_older)


def by_graph(sources: DataFrame, chosen: DataFrame, *, reject_older: bool = False) -> DataFrame:
    """(id, label, url, evidence): the graph's choice (id, label, url, confidence, visited) for law
    sources on the law site, with what speaks for it."""
    law = sources.where((strip(F.col("folder")) == LAW) & web.is_law_site(F.col("url")))
    df = law.select("id", "name", F.col("url").alias("current_url"), "current_version").join(chosen, "id")
    label = F.coalesce(falsy(F.col("label")), falsy(F.col("name")), F.lit("edition"))
    late = vs.is_not_newer(label, F.col("url"), F.col("current_url"), F.col("current_version")) if reject_older else F.lit(False)
    proof = F.struct(F.lit("eli").alias("resolver"), F.col("url").alias("chosen_url"), "confidence", "visited")
    return df.select("id", F.when(~late, label).alias("label"), F.when(~late, F.col("url")).alias("url"), proof.alias("evidence"))


def status_rows(sources: DataFrame, chain: DataFrame, graph: DataFrame, pages: DataFrame, *, mode: str = "guarded") -> DataFrame:
    """One status row per source. Law sources take the graph's or the chain's answer, as ``mode`` says;
    guidance stays manual; other sources on the law site take their page's amendments, agency sources
    what supersedes them; a page that is missing is an error."""
    c = chain.select("id", F.col("label").alias("c_label"), F.col("url").alias("c_url"))
    g = graph.select("id", F.col("label").alias("g_label"), F.col("url").alias("g_url"), "evidence")
    p = read_pages(pages).select(F.col("url").alias("p_url"), "new_label", "new_url", "over_title", "over_url", "there")
    df = sources.join(c, "id", "left").join(g, "id", "left").join(p, F.col("url") == F.col("p_url"), "left")
    law = strip(F.coalesce("folder", F.lit(""))) == LAW
    blank = F.coalesce("url", F.lit("")) == ""
    manual = law & web.is_guidance(F.col("url"), F.col("name"))
    use = updates.arbitrate(F.lit(mode), F.col("g_url"))
    r_label = F.when(use == "graph", F.col("g_label")).otherwise(F.col("c_label"))
    r_url = F.when(use == "graph", F.col("g_url")).otherwise(F.col("c_url"))
    found = r_label.isNotNull() & r_url.isNotNull()
    here = F.col("new_url").isNotNull()
    agency = web.host(F.col("url")).contains("iaea.org")
    passed = F.col("over_title").isNotNull() & F.col("over_url").isNotNull()
    current = F.col("current_version")
    error = F.when(~law & ~blank & F.col("there").isNull(), "page not found")
    kind = (
        F.when(manual, "manual").when(law & found, "law").when(law, "law unknown").when(blank, "local").when(error.isNotNull(), "error")
        .when(web.is_law_site(F.col("url")), F.when(here, "page").otherwise("page unknown")).when(agency, F.when(passed, "superseded").otherwise("current"))
        .otherwise("other")
    )
    is_ = lambda *names: F.col("kind").isin(*names)
    df = once(df.withColumn("error", error), kind=kind, r_label=r_label, r_url=r_url, use=use, is_manual=manual, is_law=law)
    label = (
        F.when(is_("manual"), MANUAL).when(is_("law"), F.col("r_label")).when(is_("law unknown"), F.when(F.coalesce("url", F.lit("")) == "", LOCAL).otherwise(UNKNOWN))
        .when(is_("local"), LOCAL).when(is_("page"), F.col("new_label")).when(is_("page unknown"), UNKNOWN).when(is_("superseded"), F.col("over_title")).when(is_("current"), "Current")
    )
    target = F.when(is_("law"), F.col("r_url")).when(is_("page"), F.col("new_url")).when(is_("superseded"), F.col("over_url")).otherwise(F.coalesce("url", F.lit("")))
    c = F.col
    newer = (
        F.when(is_("law"), vs.newer(c("url"), c("r_url"), (c("a"), c("b")), (c("c"), c("d")), (c("y"), c("z")))).when(is_("page"), strip(F.col("new_url")) != strip(F.col("url")))
        .when(is_("superseded"), F.coalesce(current != F.col("over_title"), F.lit(True))).otherwise(F.lit(False))
    )
    df = once(df, remote_version=label, **vs.compared(current, F.col("r_label"), F.col("url"), F.col("r_url")))
    return df.select(
        "id", "name", "url", "folder", "current_version", "remote_version", newer.alias("update_available"), vs.label_date(current).alias("local_date"),
        vs.label_date(F.col("remote_version")).alias("remote_date"), target.alias("download_url"), "error", F.when(F.col("is_manual"), "manual").when(F.col("is_law"), F.col("use")).alias("resolver_source"),
        F.when((F.col("use") == "graph") & F.col("is_law") | F.lit(mode == "shadow"), F.col("evidence")).alias("evidence"),
    )


def looked_up(ids: DataFrame, sources: DataFrame, chain: DataFrame, publications: DataFrame) -> DataFrame:
    """(id, url, error) for ids to look up: law sources by the chain, agency sources by their
    publication search (id, url), others not at all."""
    s = sources.withColumn("__id", strip(F.col("id").cast("string"))).dropDuplicates(["__id"]).select("__id", "id", "folder")
    df = ids.select("id", strip(F.col("id").cast("string")).alias("__id")).join(s.drop("id").withColumn("known", F.lit(True)), "__id", "left")
    df = df.join(chain.select("id", F.col("url").alias("c_url")), "id", "left").join(publications.select("id", F.col("url").alias("p_url")), "id", "left")
    law, agency = strip(F.col("folder")) == LAW, strip(F.col("folder")).isin(*AGENCY)
    url = F.when(law, F.col("c_url")).when(agency, F.col("p_url"))
    error = (
        F.when(F.col("known").isNull(), "Source not found").when(url.isNotNull(), None).when(law, "no law page found").when(agency, "no publication found")
        .otherwise("unknown folder")
    )
    return df.select("id", url.alias("url"), error.alias("error"))


def newest_or_own(sources: DataFrame, status: DataFrame, files: DataFrame, use_newest: bool = True) -> DataFrame:
    """(id, url, label, content): the newest edition's file where it was fetched, else the source's
    own. ``files``: url, content."""
    s = status.select("id", F.col("download_url").alias("n_url"), F.col("remote_version").alias("n_label"))
    df = sources.join(s, "id", "left")
    first = df.join(files.select(F.col("url").alias("n_url"), F.col("content").alias("n_content")), "n_url", "left") if use_newest else df.withColumn("n_content", F.lit(None).cast("binary"))
    both = first.join(files.select("url", F.col("content").alias("o_content")), "url", "left")
    ok = F.col("n_content").isNotNull()
    own = F.when(F.col("o_content").isNotNull(), F.col("url"))
    return both.select(
        "id", F.when(ok, F.col("n_url")).otherwise(own).alias("url"), F.when(ok, F.col("n_label")).otherwise(F.coalesce("current_version", "name")).alias("label"),
        F.coalesce("n_content", "o_content").alias("content"))
