"""Column functions on texts, urls, money and dates; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(x: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def html_to_text(x: Column) -> Column:
    return clean_text(F.regexp_replace(x, "<[^>]+>", " "))


def truncate(x: Column, limit: int) -> Column:
    return F.when(F.length(x) > limit, F.concat(F.rtrim(F.left(x, F.lit(limit - 1))), F.lit("…"))).otherwise(x)


def stem(w: Column) -> Column:
    """Light plural stemming: -ies to -y, -sses/-shes/-ches/-xes less -es, else -s (not -ss, -us)."""
    n = F.length(w)
    return (
        F.when(n <= 3, w)
        .when(F.endswith(w, F.lit("ies")), F.concat(F.substring(w, F.lit(1), n - 3), F.lit("y")))
        .when(F.endswith(w, F.lit("sses")) | F.endswith(w, F.lit("shes")) | F.endswith(w, F.lit("ches")) | F.endswith(w, F.lit("xes")), F.substring(w, F.lit(1), n - 2))
        .when(F.endswith(w, F.lit("s")) & ~F.endswith(w, F.lit("ss")) & ~F.endswith(w, F.lit("us")), F.substring(w, F.lit(1), n - 1))
        .otherwise(w)
    )


def tokens(x: Column, stop: list[str]) -> Column:
    """Lower-case stemmed words of two letters or more, without stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), " ")
    return F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop)), stem)


def title_case(handle: Column) -> Column:
    return F.initcap(F.translate(handle, "-_", "  "))


def humanize(x: Column) -> Column:
    """camelCase to words."""
    return F.lower(F.regexp_replace(x, "(?<=[a-z])(?=[A-Z])", " "))


def url_domain(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")


def url_key(url: Column) -> Column:
    """Without scheme, www, query, fragment and trailing slashes, in lower case."""
    bare = F.regexp_replace(F.lower(url), r"^[a-z]+://", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"^www\.", ""), "/+$", "")


def url_with_query(url: Column) -> Column:
    """The merger's form: no fragment, but the query stays."""
    return F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), "/+$", "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct items; 0 of nothing."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


def price_closeness(a: Column, b: Column) -> Column:
    """1 at equal prices, 0 at three times the price or more.

    About a ratio of three the logarithm is ln 3 and a small rest, rounded once: the JVM's own may be
    off in its last bit, which there decides whether anything is left.
    """
    ratio = a / b
    off = F.when(ratio > 1, (ratio - 3.0) / 3.0).otherwise(-(((ratio - F.lit(1 / 3)) + -1.850371707708594e-17) * 3.0))
    log = F.when(F.abs(off) < 1e-9, F.lit(1.0986122886681098) + (-9.07129723500153e-17 + F.when(ratio > 1, F.log1p(off)).otherwise(-F.log1p(-off)))).otherwise(F.abs(F.log(ratio)))
    return F.when((a > 0) & (b > 0), F.greatest(F.lit(0.0), F.lit(1.0) - log / 1.0986122886681098)).otherwise(F.lit(0.0))


def parse_number(x: Column) -> Column:
    """The first number of a text, thousands commas removed."""
    return F.regexp_replace(F.regexp_extract(x, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").try_cast("double")


def bigrams(x: Column) -> Column:
    """Pairs of neighbouring characters."""
    return F.when(F.length(x) > 1, F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
