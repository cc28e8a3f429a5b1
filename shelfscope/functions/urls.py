"""Url functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOCALE = "[a-z]{2}([-_][a-z]{2})?"


def collection_key(url: Column) -> Column:
    """Without scheme, query, fragment, www and trailing slashes, in lower case."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), r"^https?://", ""), r"[?#].*$", ""), r"^www\.|/+$", "")


def bare_url(url: Column) -> Column:
    """In lower case, without trailing slashes."""
    return F.regexp_replace(F.lower(F.trim(F.coalesce(url, F.lit("")))), "/+$", "")


def path_only(url: Column) -> Column:
    """The path in lower case; empty without scheme and host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")))


def handle(url: Column) -> Column:
    """What follows /collections/, else the last part of the path, in lower case."""
    named = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "/collections/([^/?#]+)", 1))
    return F.when(named != "", named).otherwise(F.element_at(F.split(F.regexp_replace(path_only(url), "/+$", ""), "/"), -1))


def is_homepage(url: Column) -> Column:
    """The root, one or two locale parts, or a locale part and a home document."""
    return F.regexp_like(F.regexp_replace(path_only(url), "^/+|/+$", ""), F.lit(f"^$|^{_LOCALE}$|^{_LOCALE}/+{_LOCALE}$|^{_LOCALE}/+(home\\.html|home|index\\.html|index|homepage)$"))


def without_tracking(url: Column) -> Column:
    """Without fragment, tracking and variant parameters, and the trailing slash of a path; null without scheme."""
    trimmed = F.regexp_replace(F.trim(url), "#.*$", "")
    params = F.filter(F.split(F.regexp_extract(trimmed, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit("^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid|variant|color)(=|$)")))
    path = F.regexp_extract(trimmed, r"^[^?]*", 0)
    path = F.when(F.regexp_like(path, F.lit("^[a-z]+://[^/]*$")), F.concat(path, F.lit("/"))).otherwise(path)
    kept = F.when(F.size(params) > 0, F.concat(path, F.lit("?"), F.array_join(params, "&"))).when(F.regexp_like(path, F.lit("^[a-z]+://[^/]*/$")), path).otherwise(F.regexp_replace(path, "/$", ""))
    return F.when(F.regexp_like(F.trim(url), F.lit("^[a-z]+://")), kept)


def pretty_path(url: Column) -> Column:
    """The path without its trailing slash; the root stays a slash."""
    whole = F.when(F.regexp_like(url, F.lit("(?i)^https?://")), url).otherwise(F.concat(F.lit("https://"), url))
    path = F.regexp_extract(whole, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when((path == "") | (path == "/"), "/").otherwise(F.regexp_replace(path, "/$", ""))


def resolve(base: Column, link: Column) -> Column:
    """A link as an absolute url: absolute, without scheme, from the root, a query or fragment, or relative with dot parts."""
    scheme = F.regexp_extract(base, "^([a-zA-Z]+:)//", 1)
    site = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]*", 0)
    path = F.regexp_extract(base, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    tail = F.regexp_extract(link, r"[?#].*$", 0)
    bare = F.regexp_replace(link, r"[?#].*$", "")
    joined = F.when(F.startswith(bare, F.lit("/")), bare).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), bare))
    parts = F.split(F.substring(joined, 2, 1 << 30), "/")
    steps = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == ".", done).when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))))
    ends = F.regexp_like(joined, F.lit(r"(^|/)\.{1,2}$")) & (F.size(steps) > 0)
    clean = F.concat(F.lit("/"), F.array_join(steps, "/"), F.when(ends, "/").otherwise(""))
    return (
        F.when(F.coalesce(link, F.lit("")) == "", base)
        .when(F.regexp_like(link, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, link))
        .when(F.startswith(link, F.lit("?")), F.concat(site, path, link))
        .when(F.startswith(link, F.lit("#")), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(site, clean, tail))
    )


def split_hreflang(tag: Column) -> Column:
    """Language and country of a locale tag: a struct, both null for x-default and what is no tag."""
    low = F.lower(F.trim(tag))
    ok = F.regexp_like(low, F.lit("^[a-z]{2}([-_][a-z]{2})?$"))
    return F.struct(F.when(ok, F.substring(low, 1, 2)).alias("language"), F.when(ok & (F.length(low) == 5), F.upper(F.substring(low, 4, 2))).alias("country"))
