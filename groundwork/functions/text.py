"""Text expressions: normalising, labels, cuts. All are native column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, functions as F

ELLIPSIS = "…"
CONTEXT_BREAK = "\n\n---\n\n"
PREFIX_CHARS = 240

#: Inputs that need no retrieval.
SMALL_TALK = (
    "thank you", "thanks", "danke", "merci", "thx", "ok", "okay", "bye", "goodbye", "tschüss", "ciao", "yes", "no", "all right",
    "alright", "got it",
)
#: Limits of a question, its history and a key.
MAX_QUESTION, MAX_TURNS, MAX_KEY = 10_000, 20, 256


def collapse(c: Column) -> Column:
    """Unicode white space becomes single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends; ``trim`` takes blanks alone."""
    return F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often it is used there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def falsy(c: Column) -> Column:
    """Empty text as null."""
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column, trim: bool = False) -> Column:
    return F.coalesce(*[falsy(strip(c) if trim else c) for c in cols])


def cut(c: Column, n: int, mark: str = ELLIPSIS) -> Column:
    """The first ``n`` characters and ``mark`` where more were there."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def dedupe_key(text: Column, source: Column, kind: Column) -> Column:
    all_of = F.coalesce(text, F.lit(""))
    # The start of a long text is enough, unless it is blanks for the most part.
    start = F.left(collapse(F.left(all_of, F.lit(4 * PREFIX_CHARS))), F.lit(PREFIX_CHARS))
    prefix = F.when(F.length(start) == PREFIX_CHARS, start).otherwise(F.left(collapse(all_of), F.lit(PREFIX_CHARS)))
    return F.concat_ws("|", F.coalesce(source, F.lit("")), F.coalesce(kind, F.lit("")), prefix)


def slug(c: Column, size: int = 48) -> Column:
    kept = F.regexp_replace(c, r"(?U)[^\w\s-]", "")
    joined = F.lower(strip(F.regexp_replace(kept, r"(?U)[-\s]+", "-")))
    return F.coalesce(falsy(F.left(joined, F.lit(size))), F.lit("doc"))


def ascii_fold(c: Column, size: int = 80) -> Column:
    """National letters as ASCII in the first ``size`` characters."""
    out = F.left(strip(c), F.lit(size))
    for old, new in (("å", "a"), ("ø", "o"), ("æ", "ae"), ("Å", "A"), ("Ø", "O"), ("Æ", "Ae")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def default_label(stem: Column) -> Column:
    return F.translate(stem, "_-", "  ")


def source_label(source: Column, kind: Column) -> Column:
    name = F.coalesce(source, F.lit("retrieved"))
    return F.when(F.coalesce(kind, F.lit("")) != "", F.concat(name, F.lit(" ("), kind, F.lit(")"))).otherwise(name)


def rendered(text: Column, source: Column, kind: Column, limit: int | None = None) -> Column:
    """A document under its source label; with ``limit`` cut with three dots."""
    body = F.coalesce(text, F.lit(""))
    return F.concat(F.lit("[Source: "), source_label(source, kind), F.lit("]\n"), body if limit is None else cut(body, limit, "..."))


def is_small_talk(c: Column) -> Column:
    t = F.lower(strip(c))
    return (F.length(t) < 3) | t.isin(*SMALL_TALK) | ~t.rlike(r"[\p{L}\p{N}]")


def reject_reason(question: Column, turns: Column, key: Column) -> Column:
    """Why a request is refused, or null."""
    return (
        F.when(F.length(question) > MAX_QUESTION, "question too long").when(turns > MAX_TURNS, "history too long")
        .when(F.length(key) > MAX_KEY, "key too long")
    )


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[^\p{L}\p{N}._\- ]", "_")


def escape_label(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def digits_list(c: Column) -> Column:
    """The integers in a list that white space and commas part."""
    return F.transform(F.filter(F.split(c, r"[\s,]+"), lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("int"))


def status_class(code: Column) -> Column:
    return F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))


def client_key(forwarded: Column, host: Column) -> Column:
    return F.coalesce(falsy(strip(F.element_at(F.split(forwarded, ","), 1))), host, F.lit("unknown"))


def collection_name(base: Column, provider: Column) -> Column:
    """Local embeddings live in collections of their own; the cloud providers share one space."""
    return F.concat(base, F.when(provider == "ollama", F.lit("-ollama")).otherwise(F.lit("")))


# Histories are arrays of struct<q, a>.
def pairs_of(history: Column) -> Column:
    """Lists of at least two strings as (q, a); shorter entries are left out."""
    return F.transform(F.filter(history, lambda x: F.size(x) >= 2), lambda x: F.struct(x[0].alias("q"), x[1].alias("a")))


def follow_up_query(question: Column, history: Column) -> Column:
    last = F.element_at(history, -1)
    text = F.concat(F.lit("Previous: "), last["q"], F.lit(". Assistant: "), cut(last["a"], 300), F.lit(". Current question: "), question)
    return F.when(F.size(history) > 0, text).otherwise(question)


def exchange_prefix(history: Column, limit: int = 400) -> Column:
    last = F.element_at(history, -1)
    text = F.concat(F.lit("Previous exchange:\nUser: "), last["q"], F.lit("\nAssistant: "), cut(last["a"], limit), F.lit("\n\n"))
    return F.when(F.size(history) > 0, text).otherwise(F.lit(""))


def history_text(history: Column) -> Column:
    lines = F.transform(history, lambda h: F.concat(F.lit("User: "), h["q"], F.lit("\nAssistant: "), h["a"]))
    return F.when(F.size(history) > 0, F.concat(F.array_join(lines, "\n\n"), F.lit("\n\n"))).otherwise(F.lit(""))


def search_restriction(query: Column, restrict: Column, domains: Sequence[str]) -> Column:
    """The query, limited to ``domains`` where ``restrict`` says so."""
    sites = " OR ".join(f"site:{d}" for d in domains)
    return F.concat(strip(query), F.when(restrict, F.lit(f" ({sites})")).otherwise(F.lit("")))


def _among(words: Sequence[str]):
    return lambda t: t.isin(*words)


def stop_word_language(text: Column, words: dict[str, Sequence[str]], default: str = "en") -> Column:
    """The language with the most of its stop words in the text; short texts take the default."""
    tokens = F.split(F.lower(text), r"[^\p{L}]+")
    scores = [
        F.struct(F.size(F.filter(tokens, _among(ws))).alias("n"), F.lit(-i).alias("o"), F.lit(lang).alias("lang"))
        for i, (lang, ws) in enumerate(words.items())
    ]
    best = F.array_max(F.array(*scores))
    return F.when((F.length(strip(text)) < 3) | (best["n"] == 0), F.lit(default)).otherwise(best["lang"])
