"""Column functions on text, identity and dates. Missing text is '' throughout, not null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def compact(x: Column | str) -> Column:
    """Without control characters, runs of (Unicode) white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(col(x).cast("string"), F.lit("")), CONTROL, " "), r"(?U)\s+", " "))


def short(x: Column | str, n: int) -> Column:
    """At most n characters, the last ones an ellipsis if text is cut off."""
    t = compact(x)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.left(t, F.lit(n - 1))), F.lit("..."))).otherwise(t)


def blank_to_null(x: Column | str) -> Column:
    return F.nullif(F.trim(col(x).cast("string")), F.lit(""))


def first_filled(*xs: Column | str) -> Column:
    """The first value that is neither null nor blank, or ''."""
    return F.coalesce(*(blank_to_null(x) for x in xs), F.lit(""))


def split_list(x: Column | str, keep: int = 30) -> Column:
    """A delimited string (; , | or newline) as its distinct, trimmed, non-empty parts in order."""
    parts = F.transform(F.split(F.coalesce(col(x), F.lit("")), r"[;,|\n]"), lambda p: F.trim(p))
    return F.slice(F.array_distinct(F.filter(parts, lambda p: p != "")), 1, keep)


def slug(x: Column | str, n: int = 80) -> Column:
    s = F.regexp_replace(F.lower(compact(x)), "[^a-z0-9_.-]+", "-")
    return F.left(F.regexp_replace(s, "^[-._]+|[-._]+$", ""), F.lit(n))


def canonical(**fields: Column) -> Column:
    """JSON with its keys in alphabetical order and '' for missing values."""
    return F.to_json(F.struct(*(F.coalesce(fields[k], F.lit("")).alias(k) for k in sorted(fields))))


def fingerprint(**fields: Column) -> Column:
    return F.sha2(canonical(**fields), 256)


def stable_id(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(value, 256), F.lit(16)))


def doi(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(col(x), F.lit("")))), r"^https?://(dx\.)?doi\.org/", "")


def identity(pmid: Column, doi_: Column, arxiv: Column, url: Column, source: Column, title: Column) -> Column:
    """The strongest identifier that is there, else a hash of source and title, else ''."""
    named = [F.concat(F.lit(f"{k}:"), blank_to_null(c)) for k, c in (("pmid", pmid), ("doi", doi_), ("arxiv", arxiv), ("url", url))]
    words = F.lower(compact(title))
    digest = F.left(F.sha2(F.concat(F.lower(compact(source)), F.lit("|"), words), 256), F.lit(20))
    return F.coalesce(*named, F.when(words != "", F.concat(F.lit("fallback:"), digest)), F.lit(""))


_URL = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def normalise_url(x: Column | str) -> Column:
    """http and https only: lower-case scheme and host, single slashes, an empty path as /, no fragment;
    else ''."""
    u = F.trim(F.coalesce(col(x), F.lit("")))
    scheme, host = F.lower(F.regexp_extract(u, _URL, 1)), F.lower(F.regexp_extract(u, _URL, 2))
    path, query = F.regexp_replace(F.regexp_extract(u, _URL, 3), "/+", "/"), F.regexp_extract(u, _URL, 4)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query)).otherwise("")


def hostname(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(col(x), F.lit("")), _URL, 2)), r"^www\.", "")


def strip_tags(x: Column | str) -> Column:
    t = F.regexp_replace(F.coalesce(col(x), F.lit("")), r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return compact(F.regexp_replace(t, "(?s)<[^>]*>", " "))


def count_matches(x: Column | str, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(col(x), F.lit("")), F.lit(pattern))


def parse_count(x: Column | str) -> Column:
    """Counts such as 1.2万, 3k or 1,024 as whole numbers (cut off, not rounded); 0 if none."""
    t = F.lower(F.regexp_replace(F.coalesce(col(x), F.lit("")), "[,\\s+]", ""))
    number = F.expr("0D") + F.coalesce(F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double"), F.lit(0.0))
    factor = F.when(t.rlike("[万w]$"), 10000.0).when(t.rlike("[千k]$"), 1000.0).otherwise(1.0)
    return F.floor(number * factor + 1e-9).cast("long")


def freshness(published: Column, as_of: Column, days: int) -> Column:
    """undated, future (more than a day ahead), fresh or stale."""
    age = F.datediff(as_of, published)
    return F.when(published.isNull(), "undated").when(age < -1, "future").when(age <= days, "fresh").otherwise("stale")


def weight_of(source: Column, weights: dict[str, float]) -> Column:
    """The weight of a kind of source, 0 for others."""
    return F.coalesce(*(F.when(source == k, F.lit(float(w))) for k, w in weights.items()), F.lit(0.0))


def term_score(hay: Column, weights: dict[str, float], penalties: dict[str, float], source_weight: Column | None = None) -> Column:
    """Sum of the weights of contained terms less that of penalties, and the source's weight, within 0
    and 1."""
    total = F.lit(0.0)
    for term, w in sorted(weights.items()):
        total = total + F.when(F.contains(hay, F.lit(term)), F.lit(float(w))).otherwise(0.0)
    for term, w in sorted(penalties.items()):
        total = total - F.when(F.contains(hay, F.lit(term)), F.lit(float(w))).otherwise(0.0)
    if source_weight is not None:
        total = total + source_weight
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def novelty(hay: Column, terms: list[str]) -> Column:
    """A quarter for each contained term, 1 at most."""
    found = F.lit(0)
    for t in terms:
        found = found + F.when(F.contains(hay, F.lit(t)), 1).otherwise(0)
    return F.least(F.lit(1.0), found * 0.25)


def matched(hay: Column, terms: list[str]) -> Column:
    """The contained terms, in the order given."""
    return F.array_compact(F.array(*(F.when(F.contains(hay, F.lit(t)), F.lit(t)) for t in terms)))


def tier(score: Column, novelty_: Column, gate: Column, must_read: float = 0.62, must_novelty: float = 0.40, skim: float = 0.30, collapsed: float = 0.10) -> Column:
    """Stale and future items are archived; must_read asks for relevance and novelty."""
    return F.when(gate.isin("stale", "future"), "archive").when((score >= must_read) & (novelty_ >= must_novelty), "must_read").when(score >= skim, "skim").when(score >= collapsed, "collapsed").otherwise("archive")


_MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def _month_number(name: Column) -> Column:
    """1 to 12 for a month's name, whole or its first three letters, else 0."""
    at = lambda names: F.array_position(F.array(*map(F.lit, names)), F.lower(name))
    return F.greatest(at(_MONTHS), at([m[:3] for m in _MONTHS])).cast("int")


def normalise_date(x: Column | str) -> Column:
    """YYYY-MM-DD from `2024-3-7` or `2024/3/7` anywhere in the text, `2024 Mar 7`, an RFC 2822 date, or
    an ISO date or time at the start, with or without hyphens (months whole or as three letters); '' if there is none, or if the first form names no real day."""
    t = compact(x)
    day = lambda y, m, d: F.date_format(F.try_to_date(F.format_string("%s-%s-%s", y, m, d), "y-M-d"), "yyyy-MM-dd")
    numbers, words, mail = r"\b(20[0-9]{2})[-/]([0-9]{1,2})[-/]([0-9]{1,2})\b", r"\b(20[0-9]{2})\s+([A-Za-z]{3,9})\s+([0-9]{1,2})\b", r"^(?:[A-Za-z]{3},?\s+)?([0-9]{1,2})\s+([A-Za-z]{3,9})\s+([0-9]{4})\b"
    part = lambda p, k: F.regexp_extract(t, p, k)
    month = lambda p: _month_number(part(p, 2))
    iso = r"^([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})(?:$|[T ])"
    first = F.when(t.rlike(numbers), F.coalesce(day(part(numbers, 1), part(numbers, 2), part(numbers, 3)), F.lit("")))
    named = lambda p, y, d: F.when(t.rlike(p) & (month(p) > 0), day(part(p, y), month(p).cast("string"), part(p, d)))
    return F.coalesce(first, named(words, 1, 3), named(mail, 3, 1), F.when(t.rlike(iso), day(part(iso, 1), part(iso, 3), part(iso, 4))), F.lit(""))


def error_rate(a: Column, b: Column) -> Column:
    """Edit distance in relation to the length of `a`."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(1))


def page_range(x: Column | str) -> Column:
    """`1,3-5` as [1, 3, 4, 5]."""
    def one(t):
        lo = F.split_part(t, F.lit("-"), F.lit(1)).try_cast("int")
        hi = F.coalesce(F.nullif(F.split_part(t, F.lit("-"), F.lit(2)), F.lit("")).try_cast("int"), lo)
        return F.when(lo.isNotNull() & (hi >= lo), F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.regexp_replace(col(x), r"\s", ""), ","), one))))


def failing(**rules: Column) -> Column:
    """Names of all rules that hold, in the order given."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))


def from_epoch(x: Column) -> Column:
    """A time from seconds or, if the number is that large, milliseconds since 1970."""
    return F.timestamp_seconds(F.when(F.abs(x) >= 100_000_000_000, x / 1000).otherwise(x))


def duration_seconds(x: Column) -> Column:
    """`1h 2m 3s`, in any part, or `1:02:03`, as whole seconds; 0 if there is none."""
    part = lambda p: F.coalesce(F.regexp_extract(x, p, 1).try_cast("int"), F.lit(0))
    colons = r"^\s*(?:(\d+):)?(\d{1,2}):(\d{2})\s*$"
    at = lambda k: F.coalesce(F.regexp_extract(x, colons, k).try_cast("int"), F.lit(0))
    return F.when(x.rlike(colons), at(1) * 3600 + at(2) * 60 + at(3)).otherwise(part(r"(\d+)\s*h") * 3600 + part(r"(\d+)\s*m") * 60 + part(r"(\d+)\s*s"))


def clock_hour(x: Column) -> Column:
    """The hour of a 12-hour clock time with a word for the part of the day, 0 to 23; null without a time."""
    hour = F.regexp_extract(x, r"(\d{1,2})\s*[:点]", 1).try_cast("int")
    late = x.rlike("下午|晚上|(?i)pm")
    noon, night = x.rlike("中午"), x.rlike("凌晨|上午|早上|(?i)am")
    return F.when((late | (noon & (hour < 11))) & (hour < 12), hour + 12).when(night & (hour == 12), 0).otherwise(hour)
