"""Hosts, allowlists, links in HTML and tolerant JSON. Patterns and hosts are fixed values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .text import ascii_fold, falsy, let, strip

#: Hosts that may be fetched, for documents (A) and for update checks (B).
HOSTS_A = (
    "www.retsinformation.dk", "retsinformation.dk", "api.retsinformation.dk", "www.iaea.org", "iaea.org", "www-pub.iaea.org", "sst.dk",
    "www.sst.dk",
)
HOSTS_B = ("www.retsinformation.dk", "retsinformation.dk", "www.iaea.org", "iaea.org", "sst.dk", "www.sst.dk")
LABEL_KEYS = ("title", "label", "name", "eli:title", "dct:title", "documentTitle", "overskrift")
FORWARD_KEYS = ("changed_by", "consolidated_by", "is_changed_by", "is_consolidated_by")


def host(url: Column) -> Column:
    """The lower-case host with port, without a leading ``www.``; empty where there is none."""
    raw = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(raw, r"^www\.", "")


def allowed_a(url: Column, hosts: tuple[str, ...] = HOSTS_A, agency: str = "iaea.org", marker: str = "retsinformation") -> Column:
    h = host(url)
    return h.isin(*hosts) | (h.endswith(".dk") & url.contains(marker)) | h.contains(agency) | url.contains(marker)


def allowed_b(url: Column, hosts: tuple[str, ...] = HOSTS_B, agency: str = "iaea.org", marker: str = "retsinformation") -> Column:
    h = host(url)
    return h.isin(*hosts) | (h.endswith(".dk") & url.contains(marker)) | (h == agency) | url.contains(marker)


def is_law_site(url: Column) -> Column:
    h = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return h.contains("retsinformation.dk") & ~h.contains("api.")


def is_guidance(url: Column, name: Column) -> Column:
    n = F.lower(F.coalesce(name, F.lit("")))
    words = ("åbne radioaktive", "aabne radioaktive", "radioaktive kilder", "sikkerhedsvurdering")
    by_name = n.contains(words[0])
    for w in words[1:]:
        by_name = by_name | n.contains(w)
    return F.lower(F.coalesce(url, F.lit(""))).contains("sst.dk") | by_name


def is_archived(title: Column, url: Column, marker: str = "historisk") -> Column:
    return F.lower(ascii_fold(F.coalesce(title, F.lit("")))).contains(marker) | F.lower(F.coalesce(url, F.lit(""))).contains(marker)


def title_fits(title: Column, wanted: Column) -> Column:
    """Containment, long suffixes, and two families of titles that name one decree."""
    w, t = strip(F.lower(ascii_fold(F.coalesce(wanted, F.lit(""))))), F.lower(ascii_fold(F.coalesce(title, F.lit(""))))
    suffix = strip(F.right(w, F.lit(40)))
    family = lambda s, out: w.contains(s) & t.contains(s) & ~t.contains(out)
    hit = (
        t.contains(w) | ((F.length(w) > 25) & (F.length(suffix) >= 15) & t.contains(suffix))
        | family("radioaktive stoffer", "transport") | family("abne radioaktive kilder", "lukkede")
    )
    return F.when(w == "", True).when(t == "", False).otherwise(hit)


def pdf_url(url: Column) -> Column:
    base = F.rtrim(url, F.lit("/"))
    return F.when(allowed_a(url), F.when(base.endswith("/pdf"), base).when(base.contains("/eli/lta/"), F.concat(base, F.lit("/pdf"))))


def xml_url(url: Column) -> Column:
    base = F.rtrim(url, F.lit("/"))
    for s in ("/pdf", "/xml", "/html"):
        base = F.when(base.endswith(s), F.left(base, F.length(base) - len(s))).otherwise(base)
    known = base.contains("/eli/lta/") | base.contains("/eli/accn/")
    return F.when(allowed_a(url) & known, F.concat(base, F.lit("/xml")))


def metadata_url(url: Column) -> Column:
    base = F.rtrim(url, F.lit("/"))
    return F.when(base.endswith(".json"), base).otherwise(F.concat(base, F.lit(".json")))


def publication_pdf(html: Column, agency: str = "iaea") -> Column:
    """Three patterns by priority; relative paths become absolute."""
    full = F.element_at(F.split(F.regexp_extract(html, r'(?i)href="(https?://[^"]+\.pdf[^"]*)"', 1), " "), 1)
    path = strip(F.regexp_extract(html, r'(?i)href="([^"]*MTCD/Publications/PDF/[^"]+\.pdf[^"]*)"', 1))
    slash = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    path = F.when(path == "", None).when(path.startswith("http"), path).otherwise(F.concat(F.lit("https://www-pub.iaea.org"), slash))
    same = strip(F.regexp_extract(html, r'(?i)href="(/[^"]*\.pdf[^"]*)"', 1))
    same = F.when(same != "", F.concat(F.lit("https://www.iaea.org"), same))
    return F.coalesce(F.when(F.lower(full).contains(agency), full), path, same)


def publication_link(html: Column) -> Column:
    """The first publication link of a result page, absolute ones before relative ones."""
    h = F.regexp_replace(html, r"href='([^']+)'", 'href="$1"')
    full = falsy(F.regexp_extract(h, r'href="(https://www\.iaea\.org/publications/(\d+)/[^"]+)"', 1))
    path = falsy(F.regexp_extract(h, r'href="(/publications/(\d+)/[^"]+)"', 1))
    return F.coalesce(full, F.concat(F.lit("https://www.iaea.org"), path))


def superseded_by(html: Column) -> Column:
    link = r'(?is)Superseded\s+by\s*:\s*<a\s+href="([^"]+)"[^>]*>([^<]+)</a>'
    url, title = falsy(F.regexp_extract(html, link, 1)), strip(F.regexp_extract(html, link, 2))
    url_full = F.when(url.startswith("/"), F.concat(F.lit("https://www.iaea.org"), url)).otherwise(url)
    text = falsy(strip(F.regexp_extract(html, r"(?i)Superseded\s+by\s*:\s*([^\n<]+)", 1)))
    return F.when(url.isNotNull(), F.struct(title.alias("title"), url_full.alias("url"))).otherwise(
        F.struct(text.alias("title"), F.lit(None).cast("string").alias("url"))
    )


AMENDMENT_PATTERNS = (
    r'(?i)href="(/eli/lta/(\d+)/(\d+))"[^>]*>\s*BEK\s+nr\s+\d+\s+af\s+(\d{1,2})/(\d{1,2})/(\d{4})',
    r'(?i)href="(/eli/lta/(\d+)/(\d+))"[^>]*>(?:\s*<[^>]+>[^<]*)*\s*BEK\s+nr\s+\d+\s+af\s+(\d{1,2})/(\d{1,2})/(\d{4})',
    r'(?i)href="(/eli/lta/(\d+)/(\d+))"[^>]*>[\s\S]{0,80}?BEK\s+nr\s+(\d+)\s+af\s+(\d{1,2})/(\d{1,2})/(\d{4})',
)


def _matches(html: Column, pattern: str, path: int, nr: int, day: int) -> Column:
    """Every match as struct(date parts, position, label parts, path)."""
    whole = F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    parts = F.transform(whole, lambda x: F.split(F.regexp_replace(x, pattern, " ".join(f"${k}" for k in (day + 2, day + 1, day, nr, path))), " "))
    return F.transform(parts, lambda g, i: F.struct(
        g[0].cast("int").alias("year"), g[1].cast("int").alias("month"), g[2].cast("int").alias("day"), i.alias("pos"),
        F.concat(F.lit("BEK nr "), g[3], F.lit(" af "), g[2], F.lit("/"), g[1], F.lit("/"), g[0]).alias("label"),
        g[4].alias("path"),
    ))


def _plain_links(html: Column) -> Column:
    return F.regexp_replace(html, r"\s+href='([^']+)'", ' href="$1"')


def _by_number(h: Column) -> Column:
    """Links and labels joined by number, the last link of a number holding."""
    link = r'href="(/eli/lta/(\d+)/(\d+))"'
    paths = F.reverse(F.regexp_extract_all(h, F.lit(link), F.lit(1)))
    numbers = F.transform(paths, lambda x: F.substring_index(x, "/", -1))
    said = r"(?i)BEK\s+nr\s+(\d+)\s+af\s+(\d{1,2})/(\d{1,2})/(\d{4})"
    parts = F.transform(F.regexp_extract_all(h, F.lit(said), F.lit(0)), lambda x: F.split(F.regexp_replace(x, said, "$1 $2 $3 $4"), " "))
    labels = lambda links: F.transform(parts, lambda g, i: F.struct(
        g[3].cast("int").alias("year"), g[2].cast("int").alias("month"), g[1].cast("int").alias("day"), i.alias("pos"),
        F.concat(*[y for k, s in enumerate(("BEK nr ", " af ", "/", "/")) for y in (F.lit(s), g[k])]).alias("label"),
        F.try_element_at(links["paths"], F.nullif(F.array_position(links["numbers"], g[0]).cast("int"), F.lit(0))).alias("path"),
    ))
    return F.filter(let(F.struct(paths.alias("paths"), numbers.alias("numbers")), labels), lambda m: m["path"].isNotNull())


def _ways(h: Column) -> list[Column]:
    return [_matches(h, p, 1, *at) for p, at in zip(AMENDMENT_PATTERNS, ((3, 4), (3, 4), (4, 5)))] + [_by_number(h)]


def amendments(html: Column) -> Column:
    """The amendments that a page lists: the first pattern that matches anywhere holds for the
    page; without one, links and labels are joined by number."""
    def first(ways: list[Column]) -> Column:
        return ways[0] if len(ways) == 1 else let(ways[0], lambda found: F.when(F.size(found) > 0, found).otherwise(first(ways[1:])))

    return let(_plain_links(html), lambda h: first(_ways(h)))


def _newest(best: Column, base_url: Column) -> Column:
    base = F.when(base_url.contains("/eli/"), F.element_at(F.split(base_url, "/eli/"), 1)).otherwise(F.lit("https://www.retsinformation.dk"))
    return F.when(best.isNotNull(), F.struct(best["label"].alias("label"), F.concat(base, best["path"]).alias("url")))


def newest_amendment(html: Column, base_url: Column) -> Column:
    """(label, url) of the latest date, the last of equal dates."""
    return let(F.array_max(amendments(html)), lambda best: _newest(best, base_url))


def with_newest_amendment(pages: DataFrame, once: Callable[..., DataFrame]) -> DataFrame:
    """``pages`` (url, html) with ``n``, their :func:`newest_amendment`, each pattern tried once per page.
    ``once`` as in operators.tables."""
    df = once(pages, __h=_plain_links(F.col("html")))
    ways = _ways(F.col("__h"))
    df = once(df, __m0=ways[0])
    for i, way in enumerate(ways[1:], 1):
        df = once(df, **{f"__m{i}": F.when(F.size(f"__m{i - 1}") > 0, F.col(f"__m{i - 1}")).otherwise(way)})
    df = once(df, __best=F.array_max(f"__m{len(ways) - 1}"))
    return df.select(*[F.col(f"`{c}`") for c in pages.columns], _newest(F.col("__best"), F.col("url")).alias("n"))


def json_label(v: Column) -> Column:
    """The first of the label keys that holds text; ``v`` is a VARIANT."""
    return F.coalesce(*[falsy(strip(F.try_variant_get(v, f'$["{k}"]', "string"))) for k in LABEL_KEYS])


def change_event(v: Column) -> Column:
    """A change event from JSON with alternative keys; null without id and URL. Each key is read once: an
    element of an array is computed before the function on it, however often that uses it."""
    first = lambda *keys: F.coalesce(*[falsy(F.get_json_object(v, f"$.{k}")) for k in keys], F.lit(""))
    read = F.struct(
        strip(first("documentId", "id", "accessionNumber", "accessionsnummer")).alias("ident"), strip(first("eli", "url", "href", "documentUrl")).alias("url"),
        first("changedAt", "updatedAt", "modifiedAt").alias("changed_at"), first("reasonForChange", "reason").alias("reason"))

    def event(r: Column) -> Column:
        made = F.struct(
            F.lit("harvest_api").alias("source"), F.coalesce(falsy(r["ident"]), r["url"]).alias("identifier"), r["url"].alias("url"),
            falsy(r["changed_at"]).alias("changed_at"), falsy(r["reason"]).alias("reason"))
        return F.when((r["ident"] != "") | (r["url"] != ""), made)

    return let(read, event)


SEARCH_RESULT = "struct<title:string,link:string,url:string,snippet:string,description:string>"


def search_results(payload: Column) -> Column:
    """Search results from a JSON list, or from an object's ``results``."""
    listed = F.from_json(payload, f"array<{SEARCH_RESULT}>")
    inside = F.from_json(payload, f"struct<results:array<{SEARCH_RESULT}>>")["results"]
    items = F.when(F.ltrim(payload).startswith("["), listed).otherwise(inside)
    return F.transform(F.coalesce(items, F.array().cast(f"array<{SEARCH_RESULT}>")), lambda r: F.struct(
        F.coalesce(r["title"], F.lit("")).alias("title"), F.coalesce(falsy(r["link"]), r["url"], F.lit("")).alias("link"),
        F.coalesce(falsy(r["snippet"]), r["description"], F.lit("")).alias("snippet"),
    ))


def looks_like_xml(content: Column, least: int = 5000) -> Column:
    head = F.lower(F.ltrim(F.decode(F.substring(content, 1, 200), "UTF-8")))
    return (F.length(content) >= least) & (head.startswith("<?xml") | head.contains("<dokument") | head.startswith("<"))


def is_pdf(content: Column, limit: int = 50 * 1024 * 1024) -> Column:
    return (F.length(content) <= limit) & (F.substring(content, 1, 4) == F.lit(b"%PDF"))


def as_text(content: Column) -> Column:
    """Bytes as UTF-8, what is none replaced."""
    return F.make_valid_utf8(content.cast("string"))
