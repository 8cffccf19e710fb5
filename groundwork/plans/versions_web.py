"""Queries: version labels and recency, the registry, hosts and HTML, lineage, change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx, versions as vs, web
from ..operators import dedupe, lineage, registry
from ..operators.tables import once
from .tables import LABELLED, labelled_orders, t


def label_date_nr(spark, sf_dir):
    o = labelled_orders(spark, sf_dir)
    got = vs.label_date_nr(F.col("label"))
    return o.select("nr", got["issue_date"].cast("string").alias("issue_date"), got["nr"].alias("label_nr"))


def label_year_nr(spark, sf_dir):
    o = labelled_orders(spark, sf_dir)
    a, b = vs.label_year_nr(F.col("label")), vs.url_year_nr(F.col("url"))
    return o.select("nr", a["year"].alias("year"), a["nr"].alias("label_nr"), b["year"].alias("url_year"), b["nr"].alias("url_nr"))


def _series(spark, sf_dir):
    """Each customer's earliest edition as what is held and each edition as a candidate."""
    o = labelled_orders(spark, sf_dir)
    held = o.groupBy("series").agg(F.min_by(F.struct("label", "url"), F.struct("day", "nr")).alias("h"))
    return o.join(held, "series").select("series", "nr", "label", "url", F.col("h.label").alias("held_label"), F.col("h.url").alias("held_url"))


def recency_reject(spark, sf_dir):
    s = _series(spark, sf_dir)
    return s.select("series", "nr", vs.is_not_newer(F.col("label"), F.col("url"), F.col("held_url"), F.col("held_label")).alias("rejected"))


def update_available(spark, sf_dir):
    """Per customer whether the newest edition updates the first one; none without editions."""
    o = labelled_orders(spark, sf_dir)
    first, last = (f(F.struct("label", "url"), F.struct("day", "nr")) for f in (F.min_by, F.max_by))
    per = o.groupBy("series").agg(first.alias("a"), last.alias("b"))
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    both = c.join(per, c["id"] == per["series"], "left")
    known = vs.update_available(F.col("a.label"), F.col("b.label"), F.col("a.url"), F.col("b.url"))
    return both.select("id", "name", F.col("b.label").alias("remote_version"), F.coalesce(F.when(F.col("b").isNotNull(), known), F.lit(False)).alias("update_available"))


def newest_version(spark, sf_dir):
    o = labelled_orders(spark, sf_dir)
    return o.groupBy("series").agg(F.max_by("label", F.struct("day", "nr")).alias("label"))


def best_candidate(spark, sf_dir):
    """The latest edition by date, year and number; of equal ones the first."""
    o = labelled_orders(spark, sf_dir)
    rank = F.struct(F.col("day").isNotNull(), "day", F.year("day"), -F.col("nr"))
    return o.groupBy("series").agg(F.max_by("url", rank).alias("url"))


def retention_keep2(spark, sf_dir):
    o = labelled_orders(spark, sf_dir)
    return dedupe.newest(o, ["series"], [F.col("day").desc(), F.col("nr").desc()], 2).select("series", "nr", "rank")


def registry_suffix_ids(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", tx.slug(F.col("p_name")).alias("id"))
    return dedupe.suffix_ids(p, "id", ["p_partkey"]).select("p_partkey", "unique_id")


def registry_merge_id_or_name(spark, sf_dir):
    """Parts as discovered rows, customers as known ones that share an id or a segment name."""
    found = t(spark, sf_dir, "part").select((F.col("p_partkey") * 2).cast("string").alias("id"), F.concat(F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("name"))
    c = t(spark, sf_dir, "customer")
    known = c.select(
        F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit(" "), F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit(" ")).alias("name"),
        F.when(F.col("c_nationkey") % 2 == 0, F.col("c_name")).alias("url"), F.col("c_mktsegment").alias("version"), F.col("c_custkey").alias("ord"),
    )
    return registry.merge_discovered(found, known).select("id", "known_id", "known_url", "known_version")


def registry_upsert(spark, sf_dir):
    """Orders as changes of version state: the latest per customer over the customers' own."""
    o = labelled_orders(spark, sf_dir)
    state = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("none").alias("version"), F.to_date(F.lit("1996-01-01")).alias("updated_at"))
    changes = o.groupBy(F.col("series").alias("id")).agg(F.max_by("label", F.struct("day", "nr")).alias("version"), F.max("day").alias("updated_at"))
    return registry.upsert(state, changes, "id", "updated_at").withColumn("updated_at", F.col("updated_at").cast("string"))


def registry_current_version(spark, sf_dir):
    """State, then registry, then disk, each by id."""
    c = t(spark, sf_dir, "customer")
    sources = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.lit("")).alias("version"))
    o = labelled_orders(spark, sf_dir)
    state = o.where(F.month("day") > 6).groupBy(F.col("series").alias("id")).agg(F.max_by("label", F.struct("day", "nr")).alias("version"))
    disk = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("version"))
    return registry.with_current(sources, state, disk).select("id", "current_version")


def source_file_resolution(spark, sf_dir):
    """Parts as files in the folder of their brand, suppliers as sources with a hint in the name."""
    files = t(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), F.concat_ws("_", F.col("p_partkey").cast("string"), "p_name").alias("name"))
    files = files.withColumn("path", F.concat_ws("/", "folder", "name"))
    s = t(spark, sf_dir, "supplier")
    sources = s.select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 5 + 1).cast("string"), F.lit("1")).alias("folder"),
        F.concat((F.col("s_suppkey") % 10).cast("string"), F.lit("_")).alias("filename_hint"),
    )
    return registry.local_file(sources, files)


def probe_years(spark, sf_dir):
    """Per customer the latest of six years with an edition of that customer's number."""
    o = labelled_orders(spark, sf_dir).select(F.year("day").alias("year"), F.col("series").alias("nr")).distinct()
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("nr"), F.explode(F.sequence(F.lit(1993), F.lit(1998))).alias("year"))
    return c.join(o, ["nr", "year"]).groupBy("nr").agg(F.max("year").alias("year"))


def lineage_closure(spark, sf_dir):
    e, s = _graph(spark, sf_dir)
    return lineage.reachable(s, e)


def _graph(spark, sf_dir):
    """Orders as nodes, edges from k to 2k where that order exists; starts are the orders that no
    edge leads to."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    e = o.select(F.col("k").alias("src"), (F.col("k") * 2).alias("dst")).join(o.select(F.col("k").alias("dst")), "dst", "left_semi").select("src", "dst")
    return e, o.select(F.col("k").alias("start")).join(e.select(F.col("dst").alias("start")), "start", "left_anti")


def _best(spark, sf_dir):
    e, s = _graph(spark, sf_dir)
    nodes = labelled_orders(spark, sf_dir).select(F.col("nr").alias("node"), F.col("day").alias("issue_date"), F.year("day").alias("year"), "nr")
    return lineage.best_node(lineage.reachable(s, e), nodes)


def lineage_best_node(spark, sf_dir):
    return _best(spark, sf_dir).select("start", "chosen")


def lineage_confidence(spark, sf_dir):
    b = _best(spark, sf_dir)
    return b.select("start", F.round(vs.confidence(F.col("chosen"), F.col("start"), F.col("issue_date")), 3).alias("confidence"))


def url_host(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", web.host(F.col("url")).alias("host"))


_HOSTS = ("therha.example.com", "thther.example.org", "blog.ththan.example.net")


def url_allowlist_a(spark, sf_dir):
    ok = web.allowed_a(F.col("url"), _HOSTS, "example.net", "utm_source")
    return t(spark, sf_dir, "pages").select("page_id", ok.alias("allowed"))


def url_allowlist_b(spark, sf_dir):
    ok = web.allowed_b(F.col("url"), _HOSTS, "thther.example.net", "utm_source")
    return t(spark, sf_dir, "pages").select("page_id", ok.alias("allowed"))


def html_links(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    return p.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("pos", "href"))


def html_first_link(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    first = lambda r: tx.falsy(F.regexp_extract("html", r, 1))
    return p.select("page_id", F.coalesce(first('href="(https?://[^"]+)"'), F.concat(F.lit("https://example.org"), first('href="(/[^"]+)"'))).alias("link"))


def html_title_slug(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return t(spark, sf_dir, "pages").select("page_id", tx.slug(title).alias("slug"))


def _amendment_pages(spark, sf_dir):
    """Per customer a page that lists its orders as amendments, for odd customers with the labels
    apart from the links."""
    o = labelled_orders(spark, sf_dir)
    path = F.regexp_replace("url", "^https://www.retsinformation.dk", "")
    linked = F.concat(F.lit("<a href='"), path, F.lit("'>"), F.lit(" "), "label", F.lit("</a>"))
    apart = F.concat(F.lit('<a href="'), path, F.lit('">se</a>' + "-" * 90), "label")
    rows = o.select("series", "nr", F.when(F.col("series") % 2 == 0, linked).otherwise(apart).alias("h"))
    parts = F.array_sort(F.collect_list(F.struct("nr", "h")))
    return rows.groupBy("series").agg(F.array_join(F.transform(parts, lambda x: x["h"]), "\n").alias("html"))


def amendments_newest(spark, sf_dir):
    got = web.newest_amendment(F.col("html"), F.lit("https://www.retsinformation.dk/eli/lta/2000/1"))
    return _amendment_pages(spark, sf_dir).select("series", got["label"].alias("label"), got["url"].alias("url"))


def superseded_by(spark, sf_dir):
    o = labelled_orders(spark, sf_dir)
    linked = F.concat(F.lit("<p>Superseded by: <a href=\"/pub/"), F.col("nr").cast("string"), F.lit('" class="x"> '), "label", F.lit(" </a>"))
    plain = F.concat(F.lit("<p>superseded BY : "), "label", F.lit(" <br>"))
    html = F.when(F.col("nr") % 3 == 0, linked).when(F.col("nr") % 3 == 1, plain).otherwise(F.lit("<p>current</p>"))
    got = web.superseded_by(html)
    return o.select("nr", got["title"].alias("title"), got["url"].alias("url"))


def document_urls(spark, sf_dir):
    o = labelled_orders(spark, sf_dir)
    return o.select("nr", web.pdf_url(F.col("url")).alias("pdf"), web.xml_url(F.concat("url", F.lit("/pdf/"))).alias("xml"), web.metadata_url(F.col("url")).alias("meta"))


def event_normalise(spark, sf_dir):
    """Events as change items: their JSON with alternative keys."""
    e = t(spark, sf_dir, "events")
    item = F.to_json(F.struct(
        F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).alias("id"), F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("doc-"), F.col("event_id").cast("string"))).alias("documentId"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("/e/"), F.col("event_id").cast("string"))).alias("href"), F.col("event_type").alias("reason"),
    ))
    rows = e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), item.alias("item"))
    rows = once(rows, c=web.change_event(F.col("item"))).where("c IS NOT NULL")
    return rows.select("event_id", "k", "c.identifier", "c.url", "c.reason")


def json_relations(spark, sf_dir):
    """Forward relations found anywhere in nested JSON built from the events."""
    from ..sources.relations import walk_relations

    e = t(spark, sf_dir, "events").select("event_id", F.concat(
        F.lit('{"eli:changed_by":[{"@id":"/n/'), F.col("event_id").cast("string"), F.lit('"},"/n/'), F.col("user_id").cast("string"),
        F.lit('"],"x":{"is_consolidated_by":{"href":"/m"}},"p":'), "props", F.lit("}")).alias("json"))
    return walk_relations(e, "json")


def harvest_day_window(spark, sf_dir):
    """Per user the days from the last event to the end of the month, ten at most."""
    e = t(spark, sf_dir, "events").groupBy("user_id").agg(F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last"))
    today = F.to_date(F.lit("2024-01-31"))
    days = F.transform(vs.day_window(F.col("last"), today), lambda d: d.cast("string"))
    return e.select("user_id", F.explode(days).alias("day"))


QUERIES = {f.__name__: f for f in (
    label_date_nr, label_year_nr, recency_reject, update_available, newest_version, best_candidate, retention_keep2, registry_suffix_ids,
    registry_merge_id_or_name, registry_upsert, registry_current_version, source_file_resolution, probe_years, lineage_closure, lineage_best_node,
    lineage_confidence, url_host, url_allowlist_a, url_allowlist_b, html_links, html_first_link, html_title_slug, amendments_newest, superseded_by,
    document_urls, event_normalise, json_relations, harvest_day_window,
)}

_CLOSURE = f"""WITH RECURSIVE e AS (SELECT a.o_orderkey AS src, b.o_orderkey AS dst FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey * 2),
c AS (SELECT o_orderkey AS start, o_orderkey AS node, 0 AS depth FROM orders WHERE o_orderkey NOT IN (SELECT dst FROM e)
  UNION ALL SELECT start, dst, depth + 1 FROM c JOIN e ON src = node WHERE depth < 12),
{LABELLED},
b AS (SELECT start, arg_max(node, row(day, year(day), nr, -depth)) AS chosen FROM c JOIN lo ON nr = node GROUP BY 1)"""
_H = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_HOST = f"regexp_replace({_H}, '^www\\.', '')"
_LIST = ", ".join(f"'{h}'" for h in _HOSTS)

ORACLE = {
    "label_date_nr": f"WITH {LABELLED} SELECT nr, day::VARCHAR AS issue_date, nr::INT AS label_nr FROM lo",
    "label_year_nr": f"WITH {LABELLED} SELECT nr, year(day)::INT AS year, nr::INT AS label_nr, year(day)::INT AS url_year, nr::INT AS url_nr FROM lo",
    "recency_reject": f"""WITH {LABELLED}, h AS (SELECT series, min(row(day, nr)) AS h FROM lo GROUP BY 1)
SELECT series, nr, row(day, nr) <= h AS rejected FROM lo JOIN h USING (series)""",
    "update_available": f"""WITH {LABELLED}, p AS (SELECT series, min(row(day, nr)) AS a, max(row(day, nr)) AS b, arg_max(label, row(day, nr)) AS remote FROM lo GROUP BY 1)
SELECT c_custkey AS id, c_name AS name, remote AS remote_version, coalesce(b > a, false) AS update_available FROM customer LEFT JOIN p ON c_custkey = series""",
    "newest_version": f"WITH {LABELLED} SELECT series, arg_max(label, row(day, nr)) AS label FROM lo GROUP BY 1",
    "best_candidate": f"WITH {LABELLED} SELECT series, arg_max(url, row(day, -nr)) AS url FROM lo GROUP BY 1",
    "retention_keep2": f"""WITH {LABELLED} SELECT series, nr, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC, nr DESC) AS rank FROM lo) WHERE rank <= 2""",
    "registry_suffix_ids": """WITH s AS (SELECT p_partkey, left(lower(trim(regexp_replace(regexp_replace(p_name, '[^\\w\\s-]', '', 'g'), '[-\\s]+', '-', 'g'))), 48) AS id FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) - 1 AS k FROM s)
SELECT p_partkey, CASE WHEN k = 0 THEN id ELSE id || '-' || k END AS unique_id FROM n""",
    "registry_merge_id_or_name": """WITH f AS (SELECT (p_partkey * 2)::VARCHAR AS id, p_partkey AS nm FROM part),
j AS (SELECT f.id, c.*, row_number() OVER (PARTITION BY f.id ORDER BY c_custkey) AS r FROM f JOIN customer c ON c.c_custkey::VARCHAR = f.id OR c.c_custkey = f.nm)
SELECT f.id, c_custkey::VARCHAR AS known_id, CASE WHEN c_nationkey % 2 = 0 THEN c_name ELSE '' END AS known_url, c_mktsegment AS known_version
FROM f LEFT JOIN j ON j.id = f.id AND r = 1""",
    "registry_upsert": f"""WITH {LABELLED}, u AS (SELECT series AS id, arg_max(label, row(day, nr)) AS version, max(day) AS updated_at, 1 AS n FROM lo GROUP BY 1
  UNION ALL SELECT c_custkey, 'none', DATE '1996-01-01', 0 FROM customer)
SELECT id, arg_max(version, row(updated_at, n)) AS version, max(updated_at)::VARCHAR AS updated_at FROM u GROUP BY 1""",
    "registry_current_version": f"""WITH {LABELLED}, s AS (SELECT series, arg_max(label, row(day, nr)) AS v FROM lo WHERE month(day) > 6 GROUP BY 1)
SELECT c_custkey AS id, coalesce(v, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, c_name) AS current_version FROM customer LEFT JOIN s ON series = c_custkey""",
    "source_file_resolution": """WITH f AS (SELECT p_brand AS folder, p_partkey || '_' || p_name AS name FROM part),
s AS (SELECT s_suppkey AS id, 'Brand#' || (s_nationkey % 5 + 1) || '1' AS folder, (s_suppkey % 10) || '_' AS hint FROM supplier)
SELECT id, min(CASE WHEN contains(name, hint) THEN s.folder || '/' || name END) AS path FROM s LEFT JOIN f USING (folder) GROUP BY 1""",
    "probe_years": """SELECT c_custkey AS nr, max(year(o_orderdate))::INT AS year FROM customer JOIN orders ON o_custkey = c_custkey
WHERE year(o_orderdate) BETWEEN 1993 AND 1998 GROUP BY 1""",
    "lineage_closure": f"{_CLOSURE} SELECT start, node, depth FROM c",
    "lineage_best_node": f"{_CLOSURE} SELECT start, chosen FROM b",
    "lineage_confidence": f"{_CLOSURE} SELECT start, CASE WHEN chosen <> start THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM b",
    "url_host": f"SELECT page_id, {_HOST} AS host FROM pages",
    "url_allowlist_a": f"""SELECT page_id, h IN ({_LIST}) OR (ends_with(h, '.dk') AND contains(url, 'utm_source')) OR contains(h, 'example.net') OR contains(url, 'utm_source') AS allowed
FROM (SELECT *, {_HOST} AS h FROM pages)""",
    "url_allowlist_b": f"""SELECT page_id, h IN ({_LIST}) OR (ends_with(h, '.dk') AND contains(url, 'utm_source')) OR h = 'thther.example.net' OR contains(url, 'utm_source') AS allowed
FROM (SELECT *, {_HOST} AS h FROM pages)""",
    "html_links": """SELECT page_id, (i - 1)::INT AS pos, x AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS x,
  generate_subscripts(regexp_extract_all(html, 'href="([^"]+)"', 1), 1) AS i FROM pages)""",
    "html_first_link": """SELECT page_id, coalesce(nullif(regexp_extract(html, 'href="(https?://[^"]+)"', 1), ''),
  'https://example.org' || nullif(regexp_extract(html, 'href="(/[^"]+)"', 1), '')) AS link FROM pages""",
    "html_title_slug": """SELECT page_id, coalesce(nullif(left(lower(trim(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1),
  '[^\\p{L}\\p{M}\\p{N}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'))), 48), ''), 'doc') AS slug FROM pages""",
    "amendments_newest": f"WITH {LABELLED} SELECT series, arg_max(label, row(day, nr)) AS label, arg_max(url, row(day, nr)) AS url FROM lo GROUP BY 1",
    "superseded_by": f"""WITH {LABELLED} SELECT nr, CASE WHEN nr % 3 < 2 THEN label END AS title,
  CASE WHEN nr % 3 = 0 THEN 'https://www.iaea.org/pub/' || nr END AS url FROM lo""",
    "document_urls": f"WITH {LABELLED} SELECT nr, url || '/pdf' AS pdf, url || '/xml' AS xml, url || '.json' AS meta FROM lo",
    "event_normalise": """SELECT event_id, k, identifier, url, reason FROM (SELECT event_id, json_extract_string(props, '$.k')::INT AS k,
  CASE WHEN event_id % 3 = 0 THEN event_id::VARCHAR WHEN event_id % 3 = 1 THEN 'doc-' || event_id WHEN event_id % 2 = 0 THEN '/e/' || event_id END AS identifier,
  CASE WHEN event_id % 2 = 0 THEN '/e/' || event_id ELSE '' END AS url, event_type AS reason FROM events) WHERE identifier IS NOT NULL""",
    "json_relations": """SELECT event_id, 0 AS ord, 'changed_by' AS relation, '/n/' || event_id AS url FROM events
UNION ALL SELECT event_id, 1, 'changed_by', '/n/' || user_id FROM events WHERE event_id <> user_id
UNION ALL SELECT event_id, CASE WHEN event_id <> user_id THEN 2 ELSE 1 END, 'consolidated_by', '/m' FROM events""",
    "harvest_day_window": """WITH l AS (SELECT user_id, max(ts)::DATE AS last FROM events GROUP BY 1),
d AS (SELECT unnest(range(DATE '2024-01-21', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS day)
SELECT user_id, day::VARCHAR AS day FROM l, d WHERE day > last""",
}
