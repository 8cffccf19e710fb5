"""Queries: fetching, resolution of editions, the registry from disk, whole requests, metrics, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents, errors, text as tx, versions as vs, web
from ..operators import limits, vector
from ..operators.tables import once, written
from ..sources import chunking, fetch, files, hybrid
from ..streaming import streams
from . import asking, discovery, flow, resolution
from .tables import LABELLED, labelled_orders, t
from .versions_web import _amendment_pages


def fetch_pages(spark, sf_dir):
    """Every page's address fetched from the crawl, where its host may be fetched and it is not large."""
    p = t(spark, sf_dir, "pages")
    bodies = p.groupBy("url").agg(F.min("html").cast("binary").alias("body"))
    allowed = lambda u: ~web.host(u).contains("example.net")
    got = fetch.fetched(p.select("page_id", "url"), bodies, allowed, limit=1500)
    return got.select("page_id", F.octet_length("text").cast("long").alias("bytes"), "error")


def encoded_queries(spark, sf_dir):
    """Names of parts with their brand as search queries, in both spellings."""
    p = t(spark, sf_dir, "part")
    q = F.concat_ws(" / ", "p_name", "p_brand", F.lit("~ö*+"))
    return p.select("p_partkey", fetch.encoded_query(q).alias("query"), fetch.encoded_query(q, keep_slash=True).alias("path_query"))


def web_result_documents(spark, sf_dir):
    """Eight results for every conversation, some of them without snippet, title or link."""
    c = t(spark, sf_dir, "conversations")
    part = lambda k, col: F.when(F.col("turn") % k != 0, col)
    item = F.struct(part(2, F.col("text")).alias("snippet"), part(3, F.col("role")).alias("title"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("description"),
                    part(5, F.concat(F.lit(" http://x/"), F.col("turn").cast("string"))).alias("link"))
    per = c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]).alias("r"))
    docs = fetch.web_documents(web.search_results(F.to_json("r")))
    return per.select("conv_id", F.posexplode(docs).alias("pos", "d")).select("conv_id", "pos", "d.text", "d.source")


def link_number_join(spark, sf_dir):
    """Labels with the last link of their number: decrees as links and mentions that lie apart."""
    o = labelled_orders(spark, sf_dir)
    links = o.select("series", F.col("nr").cast("string").alias("nr"), F.col("nr").alias("pos"), F.regexp_replace("url", "^https://www.retsinformation.dk", "").alias("path"))
    links = links.unionByName(links.where("pos % 3 = 0").withColumns({"path": F.concat("path", F.lit("/x")), "pos": F.col("pos") + 1}))
    last = links.groupBy("series", "nr").agg(F.max_by("path", "pos").alias("path"))
    said = once(o.select("series", "label"), d=vs.label_date_nr(F.col("label"))).select("series", F.col("d.nr").cast("string").alias("nr"), F.col("d.issue_date").cast("string").alias("day"), "label")
    return said.join(last, ["series", "nr"]).select("series", "nr", "day", "label", "path")


def title_fit(spark, sf_dir):
    """Brands with names as wanted titles, part types as titles found, over all parts."""
    p = t(spark, sf_dir, "part")
    wanted = F.when(F.col("p_partkey") % 4 == 0, F.lit("Åbne radioaktive kilder")).when(F.col("p_partkey") % 4 == 1, "").otherwise(F.lower("p_name"))
    title = F.when(F.col("p_partkey") % 8 == 0, F.concat(F.lit("Om aabne / abne radioaktive kilder "), "p_name")).otherwise(F.concat(F.lit("x "), "p_name", F.lit(" "), "p_type"))
    return p.select("p_partkey", web.title_fits(title, wanted).alias("fits"))


def source_gates(spark, sf_dir):
    """Law site, guidance and archive gates over addresses made of the pages' own."""
    p = t(spark, sf_dir, "pages")
    site = F.element_at(F.array(*map(F.lit, ("https://www.retsinformation.dk/eli/", "https://api.retsinformation.dk/", "https://www.sst.dk/", "https://x.org/Historisk/"))), (F.col("page_id") % 4 + 1).cast("int"))
    url = F.concat(site, F.col("page_id").cast("string"))
    name = F.when(F.col("page_id") % 5 == 0, F.lit("Sikkerhedsvurdering af ")).otherwise(F.lit("om "))
    name = F.concat(name, F.col("url"))
    law = web.is_law_site(url)
    folder = F.element_at(F.array(F.lit(f" {resolution.LAW} "), F.lit("IAEA"), F.lit(None).cast("string")), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select("page_id", law.alias("law"), F.coalesce(law & (tx.strip(folder) == resolution.LAW), F.lit(False)).alias("law_folder"), web.is_guidance(url, name).alias("guidance"), web.is_archived(name, url).alias("archived"))


def text_helpers(spark, sf_dir):
    """Folded names, labels of file stems, safe file names, collections and lists of numbers, per part."""
    p = t(spark, sf_dir, "part")
    name = F.concat(F.lit("Ærø "), "p_name", F.lit(" på_Ø/"), "p_brand")
    return p.select(
        "p_partkey", tx.ascii_fold(name, 60).alias("folded"), tx.default_label(name).alias("label"), tx.safe_file_name(name).alias("file"),
        tx.collection_name(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, "ollama").otherwise("openai")).alias("collection"),
        F.array_join(F.transform(tx.digits_list(F.concat(F.col("p_size").cast("string"), F.lit(", x 7 "), F.col("p_partkey").cast("string"))), lambda x: x.cast("string")), "+").alias("numbers"))


def decree_numbers(spark, sf_dir):
    """The number of a decree by priority: URL, version, file version, name, id, each with a number of its
    own. Of every five rows one has all of them, and the others lack the first one, two, three or four."""
    o = labelled_orders(spark, sf_dir)
    has = lambda k, c: F.when(F.col("nr") % 5 <= k, c)
    n = lambda k: (F.col("nr") + k).cast("string")
    version = lambda k, bek: F.concat(F.lit(f"{bek} nr "), n(k), F.lit(" af 1/2/2003"))
    got = vs.decree_number(has(0, F.col("url")), has(1, version(1, "BEK")), has(2, version(2, "bek")), has(3, F.concat(F.lit("Om nr "), n(3))), F.concat(F.lit("bek-"), n(4)))
    return o.select("nr", got.alias("number"), vs.first_year(F.col("label")).alias("year"))


def publication_versions(spark, sf_dir):
    """Titles and versions of first pages that name a series in different ways."""
    p = t(spark, sf_dir, "part")
    n = F.col("p_size").cast("string")
    kinds = (F.concat(F.lit("safety  reports series NO. "), n), F.concat(F.lit("SSR-"), n, F.lit(" (Rev. 1)")), F.concat(F.lit("text SSG-"), n), F.concat(F.lit("IAEA TECDOC "), n), F.col("p_name"))
    page = F.concat(F.element_at(F.array(*kinds), (F.col("p_partkey") % 5 + 1).cast("int")), F.lit("\nwith more text"))
    got = vs.title_and_version(F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit(" "), "p_name")), page, F.concat_ws("_", "p_brand", "p_name"))
    return p.select("p_partkey", got["title"].alias("title"), got["version"].alias("version"))


def _sources(spark, sf_dir):
    """Customers as law sources that hold their first edition; a third of them have no name."""
    o = labelled_orders(spark, sf_dir)
    held = o.groupBy("series").agg(F.min_by(F.struct("label", "url"), F.struct("day", "nr")).alias("h"))
    name = F.when(F.col("series") % 3 == 0, "").otherwise(F.lit("BEK nr"))
    return held.select(F.col("series").alias("id"), name.alias("name"), F.col("h.url").alias("url"), F.lit(resolution.LAW).alias("folder"), F.col("h.label").alias("current_version"))


def _chain(spark, sf_dir):
    """The chain over these sources: search hits are a source's editions of even numbers, pages list
    all editions of odd sources, and every edition may be probed."""
    o, s = labelled_orders(spark, sf_dir), written(_sources(spark, sf_dir), "sources")
    hits = o.where("nr % 2 = 0").select(F.col("series").alias("id"), F.col("nr").alias("ord"), F.col("label").alias("title"), "url")
    pages = _amendment_pages(spark, sf_dir).join(s.select(F.col("id").alias("series"), "url"), "series").where("series % 2 = 1").select("url", "html")
    pages = resolution.read_pages(pages)
    editions = o.select(F.col("nr").cast("int").alias("nr"), F.year("day").alias("year"), "label", "url")
    return s, pages, resolution.law_chain(s, hits, pages, editions, number_hits=hits)


def law_resolution(spark, sf_dir):
    return _chain(spark, sf_dir)[2].select("id", "label", "url")


def update_status(spark, sf_dir):
    """Status rows: sources of every tenth customer have an answer of the graph, every seventh is guidance."""
    s, pages, chain = _chain(spark, sf_dir)
    s = s.withColumn("name", F.when(F.col("id") % 7 == 0, "Sikkerhedsvurdering").otherwise(F.col("name")))
    graph = s.where("id % 10 = 0").select("id", F.lit("BEK nr 1 af 1/1/2030").alias("label"), F.lit("https://www.retsinformation.dk/eli/lta/2030/1").alias("url"), F.lit(0.9).alias("confidence"), F.array("url").alias("visited"))
    rows = resolution.status_rows(s, chain, resolution.by_graph(s, graph), pages)
    return rows.select("id", "remote_version", "update_available", "download_url", "resolver_source", F.col("remote_date").cast("string").alias("remote_date"), F.col("evidence.confidence").alias("confidence"))


def any_update(spark, sf_dir):
    return update_status(spark, sf_dir).agg(F.bool_or("update_available").alias("any_update"), F.count("*").alias("sources"))


def registry_build(spark, sf_dir):
    """Decrees as markers, pages as law files, parts as agency files, customers as what is known."""
    markers = labelled_orders(spark, sf_dir).where("nr % 4 = 0").select(F.concat(F.lit("m"), F.col("series").cast("string")).alias("id"), F.col("label").alias("version"))
    page = lambda df, path, stem, folder, text: df.select(path.alias("path"), stem.alias("stem"), F.lit(folder).alias("folder"), F.lit(None).cast("string").alias("meta_title"), text.alias("page"))
    web_pages, p = t(spark, sf_dir, "pages"), t(spark, sf_dir, "part")
    laws = page(web_pages, F.format_string("l%09d", "page_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1), resolution.LAW, F.col("url"))
    agency = page(p, F.format_string("p%09d", "p_partkey"), F.col("p_name"), "IAEA", F.concat(F.lit("SSG-"), F.col("p_size").cast("string")))
    marked = discovery.from_markers(markers).withColumn("path", F.concat("id", F.lit("/"), "version"))
    return discovery.build_registry(marked, discovery.from_pages(laws), discovery.from_pages(agency)).select("id", "name", "url", "folder", "filename_hint", "version", "turn")


def path_ranks(spark, sf_dir):
    """Pages in the order of their addresses."""
    p = t(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit(" "), F.col("page_id").cast("string")).alias("path"))
    return discovery.path_order(p).select("page_id", F.col("ord").cast("long").alias("ord"))


def metrics_page(spark, sf_dir):
    """Ten metric families of a service over events as requests and labels as answered questions."""
    e = t(spark, sf_dir, "events")
    bad = F.col("event_type") == "error"
    one = lambda c: e.select(c.alias("value"))
    # Whole hundredths and decimals, half up: sums of doubles depend on their order, and ties on their last bit.
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cents = F.floor((F.max(at) - F.min(at) + 5000) / 10_000).cast("decimal(20,2)")
    spent = F.sum(F.col("value").try_cast("decimal(28,6)"))
    by = lambda df, c, name: df.groupBy(c.alias(name)).agg(F.count("*").alias("value"))
    l = t(spark, sf_dir, "labels")
    outcome = F.concat(F.when(F.col("doc_id") % 3 == 0, "web_search").otherwise("trusted_only"), F.when(F.col("toxic") == 1, "_unverified").otherwise("_verified"))
    families = [
        ("service_graph_loaded", "gauge", "1 if the workflow is loaded.", one(F.max(F.lit(1))), None),
        ("service_uptime_seconds", "gauge", "Seconds since the start.", one((cents / 100).cast("decimal(20,2)").cast("string")), None),
        ("service_http_requests_total", "counter", "Requests served.", one(F.count("*")), None),
        ("service_http_errors_total", "counter", "Responses of 400 and above.", one(F.count_if(bad)), None),
        ("service_http_request_duration_seconds_sum", "counter", "Seconds of all requests.", one(F.round(spent, 1).cast("string")), None),
        ("service_query_web_search_attempts_total", "counter", "Questions with a web search.", l.select(F.count_if(F.col("doc_id") % 3 == 0).alias("value")), None),
        ("service_query_outcomes_total", "counter", "Questions by outcome.", by(l, outcome, "outcome"), "outcome"),
        ("service_http_requests_by_path_total", "counter", "Requests by path.", by(e, F.concat(F.lit('/"'), "event_type"), "path"), "path"),
        ("service_http_errors_by_path_total", "counter", "Errors by path.", by(e.where(bad), F.concat(F.lit('/"'), "event_type"), "path"), "path"),
        ("service_http_responses_by_status_class_total", "counter", "Responses by class.", by(e, F.when(bad, "5xx").otherwise("2xx"), "status_class"), "status_class"),
    ]
    return limits.metrics_page(families)


def _requests(spark, sf_dir):
    """Every turn as a request of its conversation, a minute apart; every fourth client is local."""
    c = t(spark, sf_dir, "conversations")
    keys = F.when(F.col("conv_id") % 5 == 0, F.create_map(F.lit("none"), F.lit("x"))).otherwise(F.create_map(F.lit("mistral"), F.lit("k")))
    return c.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("client"), (F.col("turn") * 9_000_000).alias("micros"),
        F.when(F.col("turn") % 6 == 5, " Thanks ").otherwise(F.col("text")).alias("question"), F.array().cast("array<struct<q:string,a:string>>").alias("history"),
        F.when(F.col("conv_id") % 4 == 0, "ollama").otherwise("Mistral").alias("model"), keys.alias("api_keys"))


def request_gates(spark, sf_dir):
    """What stops each request: five a minute for a client."""
    return asking.gated(_requests(spark, sf_dir), limit=5).select("id", "gate", "provider")


def ask_requests(spark, sf_dir):
    """Whole requests over the turns of conversations. Retrieval searches both collections of vectors for
    the vector that the length of a query picks, or the number that it begins with; the graders go by the
    lengths of contexts and questions, so that every path is taken."""
    r = asking.gated(_requests(spark, sf_dir), limit=5)
    v = t(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") % 2).alias("collection"))
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "source", F.col("lang").alias("document_type"))
    n = v.count()

    def embed(queries):
        number = F.try_to_number(F.nullif(F.regexp_extract("query", "^([0-9]+):", 1), F.lit("")), F.lit("999999999")).cast("long")
        at = queries.select(F.col("id").alias("query_id"), (F.coalesce(number, F.length("query")) % n).alias("vec_id"))
        return at.join(v.select("vec_id", F.col("embedding").alias("query_vector")), "vec_id").drop("vec_id")

    held = v.join(d.select("vec_id"), "vec_id", "left_semi")
    one = lambda q: q.select("id", F.lit(1).alias("ord"), F.lit("found").alias("text"), F.lit("c").alias("source"), F.lit("web").alias("document_type"))
    need = lambda question: F.length(question) % 3
    models = flow.Models(
        retrieve=flow.vector_retrieval(lambda queries: vector.nearest(queries, held), d, embed), search=one,
        sufficient=flow.by_column(lambda question, context: F.length(context) >= 1500 + F.length(question) % 5 * 500, native=True),
        missing_query=flow.by_column(lambda question, context, hint: F.concat((F.length(context) + F.length(hint)).cast("string"), F.lit(":"), hint), native=True), search_query=flow.question_alone(),
        generate=flow.by_column(lambda question, context, history, retries: F.concat_ws(":", F.concat(F.lit("r"), retries.cast("string")), F.length(context).cast("string")), native=True),
        grade=flow.by_column(lambda question, context, g: F.struct((F.substring(g, 2, 1).cast("int") >= need(question)).alias("passed"), F.concat(F.lit("m"), need(question).cast("string")).alias("missing_info")), native=True),
        grounded=flow.by_column(lambda context, g: F.length(context) % 3 > 0, native=True))
    got = asking.answered(r, models)
    return got.select("id", "code", "answer", F.size("sources").alias("n_sources"), F.size("chat_history").alias("n_history"), "used_web_search", "warning", "outcome", "privacy_mode")


def stream_rate_limit_aligned(spark, sf_dir):
    """Requests that went through and were refused, per user and day, as a stream."""
    return streams.run_limited(streams.events(spark, sf_dir), 86_400, 3).select("user_id", "start", "passed", "refused")


def stream_sync(spark, sf_dir):
    """Events as changes of a source's version, applied batch by batch to the state of all users."""
    from ..operators.registry import upsert
    from ..operators.tables import folder

    schema = "id long, version string, updated_at timestamp"
    changes = streams.events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("event_id").cast("string").alias("version"), F.col("time").alias("updated_at"))

    def apply(state, batch):
        last = F.max_by(F.struct("version", "updated_at"), F.struct("updated_at", F.col("version").cast("long")))
        new = batch.groupBy("id").agg(last.alias("x")).select("id", "x.version", "x.updated_at")
        return upsert(state, new, "id", "updated_at")

    got = streams.run_sync(changes, folder(spark, "sync"), apply, spark.createDataFrame([], schema))
    return got.select("id", "version")


def chunk_structured(spark, sf_dir):
    """Headings and paragraphs of pages in chunks of sixty words at most, under their headings."""
    p = t(spark, sf_dir, "pages").select("page_id", F.posexplode(chunking.html_blocks(F.col("html"))).alias("pos", "b")).select("page_id", "pos", "b.level", "b.text")
    return chunking.structured_chunks(p, "page_id", 60)


def chunk_hybrid(spark, sf_dir):
    """Pages in chunks of 512 tokens of a public vocabulary at most, headings included."""
    import public_tokenizers

    p = t(spark, sf_dir, "pages").select("page_id", F.posexplode(chunking.html_blocks(F.col("html"))).alias("pos", "b")).select("page_id", "pos", "b.level", "b.text")
    return hybrid.hybrid_chunks(p, "page_id", hybrid.vocabulary_counter(public_tokenizers.path("byte_bpe_50k.json")))


def error_classes(spark, sf_dir):
    """Events as error messages of several kinds: rate limits, and what to do about local failures."""
    e = t(spark, sf_dir, "events")
    said = F.element_at(F.array(*map(F.lit, ("HTTP 429", "Rate Limit hit", "model x not found", "embed-1 NOT FOUND", "Connection refused", "boom"))), (F.col("event_id") % 6 + 1).cast("int"))
    kind = F.when(F.col("event_id") % 5 == 0, "ConnectError").otherwise("Error")
    return e.select("event_id", errors.is_rate_limit(said).alias("rate_limit"), errors.local_runtime_message(kind, said, "llm-1", "Embed-1", "runner").alias("message"))


def golden_cache(spark, sf_dir):
    """Passages as golden items with cached results: those of half of them, some of an older file."""
    b = t(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("question"), "item_id")
    cache = b.where("item_id % 2 = 0").select("id", F.concat(F.lit("A: "), "question").alias("generation"), F.when(F.col("item_id") % 4 == 0, "g").otherwise("old").alias("golden_path"), F.lit("m").alias("golden_modified"))
    got = files.with_cache(b, files.valid_cache(cache, "g", "m"))
    return got.select("id", F.col("generation").isNotNull().alias("cached"), F.length("generation").alias("n"))


def document_json(spark, sf_dir):
    """Documents in requests of eight through JSON and back."""
    d = t(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 8).alias("request"))
    docs = d.agg(F.collect_list(F.struct("text", "source", F.col("lang").alias("document_type"))).alias("docs"))
    back = docs.select("request", F.explode(documents.from_text(documents.to_text(F.col("docs")))).alias("d"))
    return back.groupBy("request").agg(F.count("*").alias("n"), F.sum(F.length("d.text")).alias("chars"), F.countDistinct("d.source").alias("sources"))


QUERIES = {f.__name__: f for f in (
    golden_cache, document_json, chunk_structured, chunk_hybrid, error_classes, fetch_pages, encoded_queries, web_result_documents, link_number_join, title_fit, source_gates, text_helpers, decree_numbers, publication_versions, law_resolution,
    update_status, any_update, registry_build, path_ranks, metrics_page, request_gates, ask_requests, stream_rate_limit_aligned, stream_sync,
)}

_SLUG = lambda c: f"coalesce(nullif(left(lower(trim(regexp_replace(regexp_replace({c}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]', '', 'g'), '[-\\s]+', '-', 'g'))), 48), ''), 'doc')"
#: Per source what it holds (h), its newest edition (n) and the newest among its search hits (e).
_EDITIONS = f"""{LABELLED},
o AS (SELECT *, {{'day': day, 'nr': nr, 'label': label, 'url': url, 'y': year(day)}} AS x FROM lo),
p AS (SELECT series AS id, arg_min(x, (day, nr)) AS h, arg_max(x, (day, nr)) AS n, arg_max(x, (day, nr)) FILTER (nr % 2 = 0) AS e FROM o GROUP BY 1),
q AS (SELECT *, id % 2 = 1 AS odd, id % 3 <> 0 AS named, (n.day, n.nr) > (h.day, h.nr) AS fresh,
  id % 2 = 1 AND e.nr = h.nr AS followed, (e.y, e.nr) > (h.y, h.nr) AS later, (e.day, e.nr) > (h.day, h.nr) AS after FROM p),
k AS (SELECT *, CASE WHEN named AND e IS NOT NULL AND followed AND fresh THEN 'n' WHEN named AND e IS NOT NULL AND NOT followed AND later THEN 's' WHEN odd AND fresh THEN 'n'
  WHEN NOT named AND e IS NOT NULL AND after THEN 'e' WHEN NOT named AND e IS NOT NULL AND NOT followed AND later THEN 's' WHEN odd THEN 'n' END AS how FROM q),
c AS (SELECT *, CASE how WHEN 'n' THEN n.label WHEN 'e' THEN e.label WHEN 's' THEN 'BEK nr ' || e.nr || ' (search)' END AS c_label,
  CASE how WHEN 'n' THEN n.url WHEN 'e' THEN e.url WHEN 's' THEN e.url END AS c_url FROM k)"""
_STATUS = f"""{_EDITIONS},
s AS (SELECT *, id % 10 = 0 AS g, id % 7 = 0 AS m FROM c),
u AS (SELECT id, CASE WHEN m THEN 'Manual check required' WHEN g THEN 'BEK nr 1 af 1/1/2030' WHEN c_url IS NOT NULL THEN c_label ELSE 'Cannot detect newest' END AS remote_version,
  CASE WHEN m THEN false WHEN g THEN true WHEN how = 'n' THEN fresh WHEN how IS NOT NULL THEN true ELSE false END AS update_available,
  CASE WHEN m THEN h.url WHEN g THEN 'https://www.retsinformation.dk/eli/lta/2030/1' ELSE coalesce(c_url, h.url) END AS download_url,
  CASE WHEN m THEN 'manual' WHEN g THEN 'graph' ELSE 'legacy' END AS resolver_source,
  CASE WHEN m THEN NULL WHEN g THEN '2030-01-01' WHEN how = 'n' THEN n.day::VARCHAR WHEN how = 'e' THEN e.day::VARCHAR END AS remote_date, CASE WHEN g THEN 0.9::DOUBLE END AS confidence FROM s)"""
_GATED = """r AS (SELECT conv_id || '-' || turn AS id, conv_id, turn, CASE WHEN turn % 6 = 5 THEN ' Thanks ' ELSE text END AS question,
  row_number() OVER (PARTITION BY conv_id, (turn * 9) // 60 ORDER BY turn, conv_id || '-' || turn) AS n FROM conversations),
g AS (SELECT *, CASE WHEN conv_id % 4 = 0 THEN 'ollama' ELSE 'mistral' END AS provider, lower(trim(question, chr(32) || chr(9) || chr(10) || chr(13))) AS w FROM r),
x AS (SELECT *, CASE WHEN n > 5 THEN 'limited' WHEN length(question) > 10000 THEN 'invalid'
  WHEN length(w) < 3 OR w IN ({talk}) OR NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]') THEN 'small_talk' WHEN conv_id % 5 = 0 AND provider <> 'ollama' THEN 'no_key' END AS gate FROM g)""".format(
    talk=", ".join(f"'{w}'" for w in tx.SMALL_TALK))


def _budget_length(lens: str, per: int, total: int) -> str:
    """The length of a context of documents of these lengths: see operators.context.budgeted."""
    acc = "{'l': 0::BIGINT, 'o': 0::BIGINT, 's': 0::BIGINT, 'd': 0::BIGINT}"
    rows = f"list_transform([least(x, {per}) FOR x IN {lens} IF x > 0], lambda x: {{'l': x::BIGINT, 'o': 0::BIGINT, 's': 0::BIGINT, 'd': 0::BIGINT}})"
    sep = "CASE WHEN a.o > 0 THEN 2 ELSE 0 END"
    step = f"""CASE WHEN a.d = 1 THEN a WHEN a.s + x.l + 2 <= {total} THEN {{'l': 0::BIGINT, 'o': a.o + {sep} + x.l, 's': a.s + x.l + 2, 'd': 0::BIGINT}}
      ELSE {{'l': 0::BIGINT, 'o': CASE WHEN {total} - a.s - 20 > 0 THEN a.o + {sep} + {total} - a.s - 20 + 3 ELSE a.o END, 's': a.s, 'd': 1::BIGINT}} END"""
    return f"(list_reduce([{acc}] || {rows}, lambda a, x: {step})).o"


_DOC = "{'k': %s, 'n': %s, 'l': %s, 'w': %s, 's': %s}"
_KEY = "source || '|' || lang || '|' || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 240)"
_LENS = "[x.n FOR x IN docs]"
_FOUND = _DOC % ("'c|web|found'", "5::BIGINT", "7::BIGINT", "1", "'c/web'")
#: The workflow as a recursion over states: documents are lists of key, length, length of label, whether
#: from the web, and source.
_ASKED = f"""WITH RECURSIVE {_GATED},
e AS (SELECT vec_id, label % 2 AS collection, embedding::DOUBLE[] AS v FROM embeddings), total AS (SELECT count(*) AS many FROM embeddings),
sc AS (SELECT a.vec_id AS q, b.collection, b.vec_id, round(list_inner_product(a.v, b.v), 5) AS score FROM e a, e b WHERE b.vec_id IN (SELECT doc_id FROM documents)),
top AS (SELECT *, row_number() OVER (PARTITION BY q, collection ORDER BY score DESC, vec_id) AS rank FROM sc QUALIFY rank <= 3),
dd AS (SELECT q, collection * 1000 + rank AS ord, {_KEY} AS k, length(text) AS n, length(source) + length(lang) + 3 AS l, source || '/' || lang AS s FROM top JOIN documents ON doc_id = vec_id
  QUALIFY row_number() OVER (PARTITION BY q, {_KEY} ORDER BY collection * 1000 + rank) = 1),
near AS (SELECT q, list({_DOC % ('k', 'n::BIGINT', 'l::BIGINT', '0', 's')} ORDER BY ord) AS found FROM dd GROUP BY q),
st AS (
  SELECT id, length(question)::BIGINT AS ql, provider = 'ollama' AS private, found AS docs, 1 AS retrievals, 0 AS retries, false AS attempted, '' AS generation, 'grade_documents' AS nxt, NULL::VARCHAR AS warning, false AS verified
  FROM x CROSS JOIN total LEFT JOIN near ON q = coalesce(try_cast(nullif(regexp_extract(question, '^([0-9]+):', 1), '') AS BIGINT), length(question)) % many WHERE gate IS NULL
  UNION ALL
  SELECT id, ql, private, docs, CASE WHEN nxt = 'retrieve_missing' AND retries = 0 THEN retrievals + 1 ELSE retrievals END,
    CASE WHEN nxt = 'grade_generation' AND g = 'retry' THEN retries + 1 ELSE retries END, attempted OR nxt = 'web_search',
    CASE WHEN nxt = 'generate' THEN 'r' || retries || ':' || rendered ELSE generation END,
    CASE nxt WHEN 'grade_documents' THEN CASE WHEN NOT private AND NOT enough THEN 'retrieve_missing' ELSE 'generate' END
      WHEN 'retrieve_missing' THEN CASE WHEN retries > 0 OR enough THEN 'generate' WHEN retrievals + 1 < 3 THEN 'retrieve_missing' WHEN private THEN 'generate' ELSE 'web_search' END
      WHEN 'web_search' THEN 'generate' WHEN 'generate' THEN 'grade_generation'
      WHEN 'grade_generation' THEN CASE g WHEN 'retry' THEN 'retrieve_missing' WHEN 'web_search' THEN 'web_search' ELSE 'verify' END
      WHEN 'verify' THEN CASE WHEN has AND NOT own AND attempted THEN 'verify_wider' ELSE 'done' END ELSE 'done' END,
    CASE WHEN nxt = 'verify' THEN CASE WHEN NOT has THEN 'no_trusted_sources' WHEN NOT own AND NOT attempted THEN 'not_verified_trusted_only' END
      WHEN nxt = 'verify_wider' AND NOT wider THEN 'not_verified_after_web' ELSE warning END,
    CASE nxt WHEN 'verify' THEN has AND own WHEN 'verify_wider' THEN wider ELSE verified END
  FROM (
    SELECT *, len(docs) > 0 AND {_budget_length(_LENS, 420, 3600)} >= 1500 + ql % 5 * 500 AS enough,
      coalesce(list_sum([x.n + x.l + 11 FOR x IN docs]), 0) + 7 * greatest(len(docs) - 1, 0) AS rendered,
      CASE WHEN retries >= ql % 3 THEN 'useful' WHEN attempted OR private THEN 'end' WHEN retries < 2 THEN 'retry' ELSE 'web_search' END AS g,
      len([x FOR x IN docs IF x.w = 0]) > 0 AS has, {_budget_length("[x.n FOR x IN docs IF x.w = 0]", 1200, 8000)} % 3 > 0 AS own,
      {_budget_length("list_append([x.n FOR x IN docs IF x.w = 0], 5)", 1200, 8000)} % 3 > 0 AS wider
    FROM (
      SELECT st.* EXCLUDE (docs), CASE WHEN nxt = 'retrieve_missing' THEN coalesce(docs, []) || [y FOR y IN coalesce(found, []) IF NOT list_contains([x.k FOR x IN coalesce(docs, [])], y.k)]
        WHEN nxt = 'web_search' THEN coalesce(docs, []) || [y FOR y IN [{_FOUND}] IF NOT list_contains([x.k FOR x IN coalesce(docs, [])], y.k)] ELSE coalesce(docs, []) END AS docs
      FROM st CROSS JOIN total LEFT JOIN near ON nxt = 'retrieve_missing'
        AND q = (CASE WHEN len(docs) > 0 THEN 18 + list_sum([x.n FOR x IN docs]) + 2 * (len(docs) - 1) ELSE 23 END + CASE WHEN retries > 0 THEN 2 ELSE 0 END) % many
      WHERE nxt <> 'done'))),
fin AS (SELECT * FROM st WHERE nxt = 'done')
SELECT x.id, CASE WHEN gate = 'limited' THEN 429 WHEN gate IN ('invalid', 'no_key') THEN 400 ELSE 200 END AS code,
  CASE WHEN gate IS NULL THEN generation WHEN gate = 'small_talk' THEN 'You''re welcome! Ask me anything.' END AS answer,
  CASE WHEN gate IS NULL THEN len(list_distinct([y.s FOR y IN docs])) ELSE 0 END AS n_sources, CASE WHEN gate IS NULL OR gate = 'small_talk' THEN 1 ELSE 0 END AS n_history,
  coalesce(attempted, false) AS used_web_search, warning, CASE WHEN gate IS NULL THEN CASE WHEN attempted THEN 'web_search' ELSE 'trusted_only' END || CASE WHEN verified THEN '_verified' ELSE '_unverified' END END AS outcome,
  provider = 'ollama' AS privacy_mode
FROM x LEFT JOIN fin ON fin.id = x.id"""

ORACLE = {
    "golden_cache": "SELECT item_id::VARCHAR AS id, item_id % 4 = 0 AS cached, CASE WHEN item_id % 4 = 0 THEN length(text) + 3 END AS n FROM benchmark",
    "document_json": "SELECT doc_id // 8 AS request, count(*) AS n, sum(length(text))::BIGINT AS chars, count(DISTINCT source) AS sources FROM documents GROUP BY 1",
    "chunk_structured": """WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<(h[1-6]|p|li)(?:\\s[^>]*)?>([^<]+)', 1) AS tags, regexp_extract_all(html, '(?is)<(h[1-6]|p|li)(?:\\s[^>]*)?>([^<]+)', 2) AS texts FROM pages),
u AS (SELECT page_id, unnest(tags) AS tag, unnest(texts) AS raw, generate_subscripts(tags, 1) AS pos FROM h),
b AS (SELECT page_id, pos, lower(tag[1]) = 'h' AS head, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS text FROM u),
s AS (SELECT *, sum(head::INT) OVER w AS section, last_value(CASE WHEN head THEN text END IGNORE NULLS) OVER w AS heading FROM b WHERE text <> '' WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
w AS (SELECT *, string_split(text, ' ') AS ws FROM s WHERE NOT head),
p AS (SELECT page_id, section, heading, pos, i, ws[i * 30 + 1:i * 30 + 30] AS piece FROM (SELECT *, unnest(range(0, (len(ws) - 1) // 30 + 1)) AS i FROM w)),
r AS (SELECT *, ((sum(len(piece)) OVER (PARTITION BY page_id, section ORDER BY pos, i) - len(piece)) // 30)::INTEGER AS part FROM p)
SELECT page_id, section::INTEGER AS section, part, any_value(heading) AS heading, string_agg(array_to_string(piece, ' '), ' ' ORDER BY pos, i) AS chunk, sum(len(piece))::BIGINT AS tokens FROM r GROUP BY page_id, section, part""",
    "error_classes": """SELECT event_id, event_id % 6 IN (0, 1) AS rate_limit, CASE event_id % 6 WHEN 2 THEN 'Model ''llm-1'' is not installed. Run: runner pull llm-1'
  WHEN 3 THEN 'Embedding model ''Embed-1'' is not installed. Run: runner pull Embed-1' ELSE CASE WHEN event_id % 5 = 0 OR event_id % 6 = 4 THEN 'The local runtime is not running. Start it with: runner serve'
  WHEN event_id % 6 = 0 THEN 'Local runtime error: HTTP 429' WHEN event_id % 6 = 1 THEN 'Local runtime error: Rate Limit hit' ELSE 'Local runtime error: boom' END END AS message FROM events""",
    "fetch_pages": """WITH p AS (SELECT page_id, contains(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'example.net') AS no,
  octet_length(encode(min(html) OVER (PARTITION BY url))) AS n FROM pages)
SELECT page_id, CASE WHEN NOT no AND n <= 1500 THEN n END AS bytes, CASE WHEN no THEN 'not allowed' WHEN n > 1500 THEN 'too large' END AS error FROM p""",
    "encoded_queries": """SELECT p_partkey, url_encode(q) AS query, replace(url_encode(q), '%2F', '/') AS path_query
FROM (SELECT p_partkey, p_name || ' / ' || p_brand || ' / ' || '~ö*+' AS q FROM part)""",
    "web_result_documents": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN turn % 2 <> 0 THEN text END AS s, CASE WHEN turn % 3 <> 0 THEN role END AS ti,
  CASE WHEN turn % 5 <> 0 THEN 'http://x/' || turn END AS l FROM conversations),
d AS (SELECT conv_id, i, coalesce(nullif(s, ''), ti, '') AS text, l FROM r WHERE i <= 5)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i) - 1)::INTEGER AS pos, text, coalesce(l, 'web_search') AS source FROM d WHERE text <> '' OR l IS NOT NULL""",
    "link_number_join": f"""WITH {LABELLED}, k AS (SELECT series, nr::VARCHAR AS nr, nr AS pos, substr(url, 31) AS path FROM lo UNION ALL SELECT series, nr::VARCHAR, nr + 1, substr(url, 31) || '/x' FROM lo WHERE nr % 3 = 0),
m AS (SELECT series, nr, arg_max(path, pos) AS path FROM k GROUP BY 1, 2)
SELECT series, m.nr, CAST(day AS VARCHAR) AS day, label, path FROM lo JOIN m USING (series) WHERE lo.nr::VARCHAR = m.nr""",
    "title_fit": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 8 = 0 WHEN p_partkey % 4 = 1 THEN true
  ELSE contains(lower(left('x ' || p_name || ' ' || p_type, 80)), lower(trim(left(p_name, 80)))) END AS fits FROM part""",
    "source_gates": """SELECT page_id, page_id % 4 = 0 AS law, page_id % 4 = 0 AND page_id % 3 = 0 AS law_folder, page_id % 4 = 2 OR page_id % 5 = 0 AS guidance,
  page_id % 4 = 3 AS archived FROM pages""",
    "text_helpers": """WITH n AS (SELECT *, 'Ærø ' || p_name || ' på_Ø/' || p_brand AS name FROM part)
SELECT p_partkey, replace(replace(replace(replace(replace(replace(left(name, 60), 'å', 'a'), 'ø', 'o'), 'æ', 'ae'), 'Å', 'A'), 'Ø', 'O'), 'Æ', 'Ae') AS folded, replace(replace(name, '_', ' '), '-', ' ') AS label,
  regexp_replace(name, '[^\\p{L}\\p{N}._\\- ]', '_', 'g') AS file, p_type || CASE WHEN p_size % 2 = 0 THEN '-ollama' ELSE '' END AS collection, p_size || '+7+' || p_partkey AS numbers FROM n""",
    "decree_numbers": f"WITH {LABELLED} SELECT nr, (nr + nr % 5)::INTEGER AS number, nullif(regexp_extract(label, '\\b(20\\d{{2}}|19\\d{{2}})\\b', 1), '')::INTEGER AS year FROM lo",
    "publication_versions": """WITH k AS (SELECT *, p_partkey % 5 AS k FROM part),
v AS (SELECT *, CASE k WHEN 0 THEN 'safety  reports series NO. ' || p_size WHEN 1 THEN 'SSR-' || p_size || ' (Rev. 1)' WHEN 2 THEN 'SSG-' || p_size WHEN 3 THEN 'IAEA TECDOC ' || p_size END AS v FROM k),
t AS (SELECT *, coalesce(CASE WHEN p_partkey % 7 = 0 THEN trim(p_name) END, v, CASE WHEN length(p_name) + 15 > 20 THEN left(trim(p_name), 100) END,
  replace(replace(p_brand || '_' || p_name, '_', ' '), '-', ' ')) AS title FROM v)
SELECT p_partkey, title, coalesce(v, title) AS version FROM t""",
    "law_resolution": f"WITH {_EDITIONS} SELECT id, c_label AS label, c_url AS url FROM c WHERE how IS NOT NULL",
    "update_status": f"WITH {_STATUS} SELECT * FROM u",
    "any_update": f"WITH {_STATUS} SELECT bool_or(update_available) AS any_update, count(*) AS sources FROM u",
    "registry_build": f"""WITH {LABELLED},
m AS (SELECT 'm' || series AS id, 'm' || series AS name, url, 'Bekendtgørelse' AS folder, NULL AS hint, label AS version, 'm' || series || '/' || label AS path, 0 AS turn FROM lo WHERE nr % 4 = 0),
w AS (SELECT *, regexp_extract(html, '<title>([^<]*)</title>', 1) AS stem FROM pages),
l AS (SELECT {_SLUG('stem')} AS id, CASE WHEN length(url) > 20 THEN left(url, 100) ELSE replace(replace(stem, '_', ' '), '-', ' ') END AS name, NULL AS url, 'Bekendtgørelse' AS folder, stem AS hint,
  CASE WHEN length(url) > 20 THEN left(url, 100) ELSE replace(replace(stem, '_', ' '), '-', ' ') END AS version, printf('l%09d', page_id) AS path, 1 AS turn FROM w),
f AS (SELECT * FROM (SELECT * FROM m UNION ALL SELECT * FROM l) QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn, path) = 1),
a AS (SELECT {_SLUG('p_name')} AS id, 'SSG-' || p_size AS name, NULL AS url, 'IAEA' AS folder, p_name AS hint, 'SSG-' || p_size AS version, printf('p%09d', p_partkey) AS path, 2 AS turn FROM part),
e AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY turn, path) AS i FROM (SELECT * FROM f UNION ALL SELECT * FROM a))
SELECT id || CASE WHEN i > 1 THEN '-' || (i - 1) ELSE '' END AS id, name, url, folder, hint AS filename_hint, version, turn FROM e""",
    "path_ranks": "SELECT page_id, row_number() OVER (ORDER BY url || ' ' || page_id) - 1 AS ord FROM pages",
    "metrics_page": """WITH q AS (SELECT *, event_type = 'error' AS bad FROM events),
z AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'web_search' ELSE 'trusted_only' END || CASE WHEN toxic = 1 THEN '_unverified' ELSE '_verified' END AS o, doc_id FROM labels),
h(f, name, kind, about) AS (VALUES (0, 'service_graph_loaded', 'gauge', '1 if the workflow is loaded.'), (1, 'service_uptime_seconds', 'gauge', 'Seconds since the start.'),
  (2, 'service_http_requests_total', 'counter', 'Requests served.'), (3, 'service_http_errors_total', 'counter', 'Responses of 400 and above.'),
  (4, 'service_http_request_duration_seconds_sum', 'counter', 'Seconds of all requests.'), (5, 'service_query_web_search_attempts_total', 'counter', 'Questions with a web search.'),
  (6, 'service_query_outcomes_total', 'counter', 'Questions by outcome.'), (7, 'service_http_requests_by_path_total', 'counter', 'Requests by path.'),
  (8, 'service_http_errors_by_path_total', 'counter', 'Errors by path.'), (9, 'service_http_responses_by_status_class_total', 'counter', 'Responses by class.')),
v AS (SELECT 0 AS f, '' AS label, '' AS tag, '1' AS v UNION ALL SELECT 1, '', '', printf('%d.%02d', (epoch_us(max(ts)) - epoch_us(min(ts)) + 5000) // 1000000, (epoch_us(max(ts)) - epoch_us(min(ts)) + 5000) // 10000 % 100) FROM q UNION ALL SELECT 2, '', '', count(*)::VARCHAR FROM q
  UNION ALL SELECT 3, '', '', (count(*) FILTER (bad))::VARCHAR FROM q UNION ALL SELECT 4, '', '', round(sum(TRY_CAST(value AS DECIMAL(28,6))), 1)::VARCHAR FROM q UNION ALL SELECT 5, '', '', (count(*) FILTER (doc_id % 3 = 0))::VARCHAR FROM labels
  UNION ALL SELECT 6, o, '{outcome="' || o || '"}', count(*)::VARCHAR FROM z GROUP BY o UNION ALL SELECT 7, event_type, '{path="/\\"' || event_type || '"}', count(*)::VARCHAR FROM q GROUP BY event_type
  UNION ALL SELECT 8, event_type, '{path="/\\"' || event_type || '"}', count(*)::VARCHAR FROM q WHERE bad GROUP BY event_type
  UNION ALL SELECT 9, CASE WHEN bad THEN '5xx' ELSE '2xx' END, '{status_class="' || CASE WHEN bad THEN '5xx' ELSE '2xx' END || '"}', count(*)::VARCHAR FROM q GROUP BY bad),
s AS (SELECT f, 0 AS part, '' AS label, '# HELP ' || name || ' ' || about AS line FROM h UNION ALL SELECT f, 1, '', '# TYPE ' || name || ' ' || kind FROM h UNION ALL SELECT f, 2, label, name || tag || ' ' || v FROM v JOIN h USING (f))
SELECT (row_number() OVER (ORDER BY f, part, label) - 1)::INTEGER AS ord, line FROM s""",
    "request_gates": f"WITH {_GATED} SELECT id, gate, provider FROM x",
    "ask_requests": _ASKED,
    "stream_rate_limit_aligned": """SELECT user_id, (epoch_us(ts) // 86400000000) * 86400000000 AS start, least(count(*), 3) AS passed, count(*) - least(count(*), 3) AS refused FROM events GROUP BY 1, 2""",
    "stream_sync": "SELECT user_id AS id, arg_max(event_id, (ts, event_id))::VARCHAR AS version FROM events GROUP BY 1",
}
