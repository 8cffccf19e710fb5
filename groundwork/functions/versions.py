"""Version labels, decree numbers and recency. Patterns are fixed values of the sources' formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, strip

DECREE_DATE = r"(?i)BEK\s+nr\s+(\d+)\s+af\s+(\d{1,2})/(\d{1,2})/(\d{2,4})"
DECREE_YEAR = r"(?i)BEK\s+nr\s+(\d+)\s+af\s+\d+/\d+/(\d{2,4})"
DECREE_NR = r"(?i)BEK\s+nr\s+(\d+)"
DECREE_URL = r"/eli/lta/(\d+)/(\d+)(?:/|$|\?)"


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def _group(c: Column, pattern: str, k: int) -> Column:
    return _int(F.regexp_extract(c, pattern, k))


def century(year: Column) -> Column:
    """Two-digit years: below 50 are in this century."""
    return F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year)


def _numbers(label: Column) -> Column:
    """Number, day, month and year of a label's first date as texts, read by one search; null without."""
    found = F.regexp_extract(label, DECREE_DATE, 0)
    return let(found, lambda x: F.when(x != "", F.split(F.regexp_replace(x, DECREE_DATE, "$1 $2 $3 $4"), " ")))


def _date(parts: Column) -> Column:
    """The date of :func:`_numbers`, null where there is none: days are counted from the month's first one."""
    year, month, day = century(parts[3].cast("int")), parts[2].cast("int"), parts[1].cast("int")
    at = F.when(month.between(1, 12) & day.between(1, 31), F.date_add(F.make_date(year, month, F.lit(1)), day - 1))
    return let(at, lambda d: F.when(F.month(d) == month, d))


def label_date(label: Column) -> Column:
    return let(_numbers(label), _date)


def label_date_nr(label: Column) -> Column:
    """(issue_date, nr), null where the label has none or the date does not exist."""
    return let(_numbers(label), lambda p: let(_date(p), lambda d: F.when(d.isNotNull(), F.struct(d.alias("issue_date"), p[0].cast("int").alias("nr")))))


def label_year_nr(label: Column) -> Column:
    dated = _group(label, DECREE_YEAR, 1)
    loose, year = _group(label, DECREE_NR, 1), _group(label, r"\b(20\d{2})\b", 1)
    return F.when(
        dated.isNotNull(), F.struct(century(_group(label, DECREE_YEAR, 2)).alias("year"), dated.alias("nr"))
    ).when(loose.isNotNull() & year.isNotNull(), F.struct(year.alias("year"), loose.alias("nr")))


def url_year_nr(url: Column) -> Column:
    year = _group(url, DECREE_URL, 1)
    return F.when(year.isNotNull(), F.struct(year.alias("year"), _group(url, DECREE_URL, 2).alias("nr")))


def first_year(c: Column) -> Column:
    return _group(c, r"\b(20\d{2}|19\d{2})\b", 1)


def decree_number(url: Column, version: Column, file_version: Column, name: Column, id_: Column) -> Column:
    """By priority: URL, version texts, name, id."""
    loose = [_group(c, p, 1) for c in (name, id_) for p in (r"(?i)(?:BEK\s+)?nr\s+(\d+)", r"(?i)bek[-_]?(\d+)")]
    return F.coalesce(_group(url, DECREE_URL, 2), _group(version, DECREE_NR, 1), _group(file_version, DECREE_NR, 1), *loose)


def current_year_nr(url: Column, version: Column) -> Column:
    """The later of what the URL and the version text say."""
    return F.greatest(url_year_nr(url), label_year_nr(version))


def not_newer(url: Column, remote: Column, ours: Column, remote_yn: Column, ours_yn: Column) -> Column:
    """:func:`is_not_newer` of what was read before: dates with numbers, years with numbers."""
    by_date = F.when(remote.isNotNull() & ours.isNotNull(), remote <= ours)
    by_number = F.when(remote_yn.isNotNull() & ours_yn.isNotNull(), remote_yn <= ours_yn)
    return F.when(F.coalesce(url, F.lit("")) == "", False).otherwise(F.coalesce(by_date, by_number, F.lit(False)))


def is_not_newer(label: Column, url: Column, current_url: Column, current_version: Column) -> Column:
    """Whether a candidate is to be rejected: its date, else its year and number, is not later."""
    return not_newer(url, label_date_nr(label), label_date_nr(current_version), url_year_nr(url), current_year_nr(current_url, current_version))


def newer(current_url: Column, remote_url: Column, dates: tuple[Column, Column], numbers: tuple[Column, Column], years: tuple[Column, Column]) -> Column:
    """:func:`update_available` of what was read before, ours first."""
    (a, b), (c, d), (y, z) = dates, numbers, years
    return (
        F.when(a.isNotNull() & b.isNotNull(), b > a).when(c.isNotNull() & d.isNotNull(), d > c)
        .when(y.isNotNull() & z.isNotNull(), z > y)
        .otherwise(strip(F.coalesce(current_url, F.lit(""))) != strip(F.coalesce(remote_url, F.lit(""))))
    )


def compared(current_label: Column, remote_label: Column, current_url: Column, remote_url: Column) -> dict[str, Column]:
    """What :func:`newer` compares, by name."""
    return {
        "a": label_date_nr(current_label), "b": label_date_nr(remote_label), "c": url_year_nr(current_url), "d": url_year_nr(remote_url),
        "y": F.coalesce(first_year(current_label), first_year(current_url)), "z": first_year(remote_url)}


def update_available(current_label: Column, remote_label: Column, current_url: Column, remote_url: Column) -> Column:
    """Later date and number, else later year and number, else later year, else another URL."""
    x = compared(current_label, remote_label, current_url, remote_url)
    return newer(current_url, remote_url, (x["a"], x["b"]), (x["c"], x["d"]), (x["y"], x["z"]))


def confidence(chosen: Column, start: Column, date: Column) -> Column:
    base = F.when(chosen != start, 0.9).otherwise(0.6) - F.when(date.isNull(), 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base))


def day_window(last: Column, today: Column, look_back: int = 10) -> Column:
    """The days to harvest: after the last successful one, never more than ``look_back`` ago; none
    where the last day is today."""
    start = F.greatest(F.coalesce(F.date_add(F.try_to_date(last), 1), F.date_sub(today, 1)), F.date_sub(today, look_back))
    return F.when(start <= today, F.sequence(start, today)).otherwise(F.array().cast("array<date>"))


# First-page patterns of publications, by priority.
PUBLICATION_PATTERNS = (
    r"(?i)Safety\s+Reports\s+Series\s+No\.\s*(\d+)", r"(?i)Safety\s+Standards\s+Series\s+No\.\s*([\w-]+)",
    r"(?i)(SSR-\d+(?:\s*/\s*\d+)?(?:\s*\(Rev\.\s*\d+\))?)", r"(?i)(SSG-\d+(?:\s*\(Rev\.\s*\d+\))?)",
    r"(?i)(No\.\s+SS[RGP][-\s]\d+[^.\n]{0,40})", r"(?i)IAEA[\s-](\w+)[\s-](\d+)",
)


def publication_version(page: Column) -> Column:
    """The first pattern that matches the page, trimmed, 80 characters at most."""
    hits = [F.nullif(F.regexp_extract(page, p, 0), F.lit("")) for p in PUBLICATION_PATTERNS]
    return F.left(strip(F.coalesce(*hits)), F.lit(80))


def title_and_version(meta_title: Column, page: Column, stem: Column) -> Column:
    version = publication_version(page)
    line = F.left(strip(F.element_at(F.split(page, "\n"), 1)), F.lit(100))
    title = F.coalesce(
        F.nullif(strip(meta_title), F.lit("")), version, F.when(F.length(page) > 20, F.nullif(line, F.lit(""))), F.translate(stem, "_-", "  ")
    )
    return F.struct(title.alias("title"), F.coalesce(version, title).alias("version"))


def search_terms(text: Column, version: Column, title: Column) -> Column:
    """Ordered distinct terms for a publication search, at most 80 characters each."""
    e = lambda p, k: F.regexp_extract_all(text, F.lit(p), F.lit(k))
    numbers = F.flatten(F.transform(
        e(r"(?i)STI/PUB/\s*(\d+(?:-\w+)?)", 1), lambda n: F.array(F.concat(F.lit("STI/PUB/"), n), F.concat(F.lit("STI PUB "), n))))
    words = F.slice(F.filter(F.split(title, r"(?U)\W+"), lambda w: F.length(w) > 2), 1, 5)
    parts = F.concat(
        numbers, F.transform(e(r"(?i)(?:IAEA-)?TECDOC[- ](\d+)", 1), lambda n: F.concat(F.lit("TECDOC "), n)),
        F.transform(e(r"(?i)IAEA-TECDOC-(\d+)", 1), lambda n: F.concat(F.lit("IAEA-TECDOC-"), n)),
        e(r"(?i)(SS[RGP][-\s]?\d+(?:\s*\(Rev\.\s*\d+\))?)", 1), e(r"92-0-\d[\d-]{8,14}[Xx\d]", 0), F.array(version, title),
        F.when(F.size(words) > 2, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>")),
    )
    return F.array_distinct(F.filter(F.transform(parts, lambda t: F.left(strip(t), F.lit(80))), lambda t: F.coalesce(t, F.lit("")) != ""))
