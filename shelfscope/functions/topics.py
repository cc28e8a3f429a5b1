"""What articles, products and collections are about: vocabularies and ordered rules, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import holds
from .text import text_blob

# Words of search intent, funnel stage and topic, in the order in which they are asked.
TRANSACTIONAL = ["buy", "order", "purchase", "add to cart", "checkout"]
COMMERCIAL = ["best ", "top ", "review", " vs ", "compare", "recommend", "alternative"]
LATE = ["best ", "top ", " vs ", "review", "compare", "choosing", "should i"]
TOPICS = {"how_to": ["how to", "guide", "tutorial", "tips", "steps", "ways"], "product": ["best", "review", "top", "vs", "compare", "recommend"], "education": ["what is", "benefits", "why", "about", "understand", "learn"], "lifestyle": ["routine", "daily", "weekly", "morning", "night", "seasonal"]}
SPAM = ["casino", "казино", "1win", "1вин", "pin up", "пин ап", "gamstop", "mostbet", "pokerdom", "pinco", "bookmaker", "bukmeker", "online kaszino"]


def search_intent(title: Column, text: Column, headings: Column | None = None) -> Column:
    """By the title, the first five headings and the text (of the first paragraphs)."""
    low = text_blob(title, text) if headings is None else F.lower(F.concat_ws(" ", title, F.array_join(F.slice(headings, 1, 5), " "), text))
    return F.when(holds(low, TRANSACTIONAL), "transactional").when(holds(low, COMMERCIAL), "commercial").otherwise("informational")


def funnel_stage(title: Column, has_products: Column, headings: Column | None = None) -> Column:
    """By the title and the first five headings."""
    said = F.coalesce(title, F.lit("")) if headings is None else F.concat_ws(" ", F.coalesce(title, F.lit("")), F.array_join(F.slice(headings, 1, 5), " "))
    late = holds(F.lower(said), LATE)
    return F.when(late & has_products, "bottom_of_funnel").when(late, "middle_of_funnel").otherwise("top_of_funnel")


def target_keyword(title: Column, heading: Column | None = None) -> Column:
    """The title, else the first heading, without what follows a bar or dash, in lower case (fixed behaviour)."""
    title = title if heading is None else F.coalesce(F.nullif(title, F.lit("")), heading)
    bare = F.trim(F.regexp_replace(title, r"\s*[|–—-]\s*\S+.*$", ""))
    return F.lower(F.coalesce(F.nullif(bare, F.lit("")), title))


def topic(title: Column) -> Column:
    low = F.lower(F.coalesce(title, F.lit("")))
    return F.coalesce(*[F.when(holds(low, words), name) for name, words in TOPICS.items()], F.lit("general"))


def spam_words(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, SPAM)), lambda w: F.contains(F.lower(text), w))


def label(text: Column, aliases: dict[str, list[str]]) -> Column:
    """The label with the most points, the first on ties: 2 for a phrase in the text, 1 for a word."""
    low = F.coalesce(text_blob(text), F.lit(""))
    words = F.split(F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")), " ")
    scored = []
    for k, (name, alias) in enumerate(aliases.items()):
        points = sum((F.when(F.contains(low, F.lit(a)), 2).otherwise(0) if " " in a else F.when(F.array_contains(words, a), 1).otherwise(0) for a in alias), F.lit(0))
        scored.append(F.struct(points.alias("points"), F.lit(-k).alias("k"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return F.when(best["points"] > 0, best["name"])


def product_label(name: Column, *others: Column, aliases: dict[str, list[str]]) -> Column:
    """By the name alone first, so that what is said beside cannot turn it; else by the other fields."""
    return F.coalesce(label(name, aliases), label(F.concat_ws(" ", *others), aliases))


def collection_label(url: Column, title: Column, aliases: dict[str, list[str]]) -> Column:
    """By the last part of the url, else by the title, else by both."""
    slug = F.translate(F.element_at(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), "/+$", ""), "/"), -1), "-", " ")
    return F.coalesce(label(slug, aliases), label(title, aliases), label(F.concat_ws(" ", url, title), aliases))


def first_rule(name: Column, tags: Column, description: Column, rules: list[tuple[str, str, str]]) -> Column:
    """category and type of the first pattern that name, tags and the description's first 200 letters meet."""
    text = F.lower(F.concat_ws(" ", name, F.array_join(tags, " "), F.left(F.coalesce(description, F.lit("")), F.lit(200))))
    return F.coalesce(*[F.when(F.regexp_like(text, F.lit(p)), F.struct(F.lit(c).alias("category"), F.lit(t).alias("type"))) for p, c, t in rules])


def chosen_category(own: Column, found: Column, handle: Column) -> Column:
    """The shop's own word, else what the rules find, else the collection's handle as a title."""
    return F.coalesce(F.nullif(F.trim(own), F.lit("")), found, F.initcap(F.translate(F.nullif(handle, F.lit("")), "-_", "  ")))
