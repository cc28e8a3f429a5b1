"""Queries over the catalog; importing the package registers them."""

from . import classify, compare, crawl, dedup, diff, dom, feeds, gates, homepages, insights, markup, matching, monitor, page_types, pages, pairs, quality, ranking, reports, rules, scalars, texts, topics, upkeep, views  # noqa: F401
