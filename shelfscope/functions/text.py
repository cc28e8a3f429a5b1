"""Text functions of the analyzers and matchers; all stay in the JVM but unescape()."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import clean_text, stem

# The word lists of the reference's tokenizers.
COMPARE_STOP = ["the", "and", "or", "for", "with", "of", "in", "on", "to", "a", "an", "shop", "online", "best", "new"]
SUGGEST_STOP = ["the", "a", "an", "and", "for", "with", "of", "in", "to", "by", "on", "new", "best", "premium", "original", "pack", "set", "ml", "gm", "g", "makeup", "make", "up", "long", "lasting", "waterproof", "matte", "finish", "natural", "look", "color", "colour", "shade", "professional"]
# Labels of calls to action that have one spelling.
CTA_LABELS = {"sign up": "Sign Up", "get started": "Get Started", "talk to sales": "Talk to Sales", "contact sales": "Contact Sales", "contact us": "Contact Us", "request demo": "Request Demo", "request a demo": "Request a Demo", "try for free": "Try for Free", "start free trial": "Start Free Trial", "subscribe": "Subscribe", "download": "Download", "learn more": "Learn More", "get pro": "Get Pro"}
# The units that sizes are written in, and the unit that some of them count as.
UNITS = ["ml", "l", "litre", "liter", "g", "kg", "mg", "oz", "gb", "tb", "mb", "inch", "inches", "cm", "mm", "w", "kw", "watt", "watts", "v", "volt", "mah", "hz", "pcs", "pc", "piece", "pieces", "pack", "pair", "pairs", "seater", "ton", "btu", "rpm", "mp"]
UNIT_NAMES = {"litre": "l", "liter": "l", "inches": "inch", "watt": "w", "watts": "w", "volt": "v", "pc": "pcs", "piece": "pcs", "pieces": "pcs", "pair": "pairs"}
UNIT_PATTERN = r"\b([0-9]+(?:\.[0-9]+)?)\s?(" + "|".join(sorted(UNITS, key=lambda u: -len(u))) + r")\b"


def mapped(x: Column, names: dict[str, str]) -> Column:
    """The value that a small fixed table has for x; null if none."""
    return F.element_at(F.create_map(*[F.lit(v) for pair in names.items() for v in pair]), x)


def clean_markup_text(x: Column) -> Column:
    """Non-breaking blanks to blanks, the marks of wrong decoding and DEL away, collapsed; null if nothing is left."""
    plain = F.replace(F.replace(x, F.lit(" "), F.lit(" ")), F.lit("&nbsp;"), F.lit(" "))
    plain = F.replace(F.replace(plain, F.lit("Â"), F.lit("")), F.lit("\x7f"), F.lit(""))
    return F.nullif(clean_text(plain), F.lit(""))


@F.pandas_udf(StringType())
def unescape(x: pd.Series) -> pd.Series:
    """All of HTML's character references; the JVM has no function for the 2,000 named ones."""
    return x.map(html.unescape, na_action="ignore")


def strip_html(x: Column) -> Column:
    """Tags to blanks, references decoded, collapsed; null becomes empty."""
    return clean_text(F.replace(unescape(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", " ")), F.lit("\u00a0"), F.lit(" ")))


def text_blob(*parts: Column) -> Column:
    """The parts that are not empty, joined by blanks, in lower case."""
    return F.lower(F.concat_ws(" ", *[F.nullif(clean_text(p), F.lit("")) for p in parts]))


def stem_slug(w: Column) -> Column:
    """The slug matcher's stem: -ies to -y, -es after ch, sh, ss, x or z away, other -es less s, -s (not -ss) away."""
    n = F.length(w)
    cut = lambda k: F.substring(w, F.lit(1), n - k)
    return F.when(n <= 3, w).when(w.endswith("ies"), F.concat(cut(3), F.lit("y"))).when(w.rlike("(ch|sh|ss|x|z)es$"), cut(2)).when(w.endswith("es") & (n > 4), cut(1)).when(w.endswith("s") & ~w.endswith("ss"), cut(1)).otherwise(w)


def words(x: Column, stop: list[str]) -> Column:
    """Distinct lower-case words of two letters or more that are no stop words, sorted."""
    found = F.split(F.trim(F.regexp_replace(F.lower(clean_text(x)), "[^a-z0-9]+", " ")), " ")
    return F.array_sort(F.array_distinct(F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(stop))))


def core_tokens(x: Column, stop: list[str], marketing: list[str], brand: Column) -> Column:
    """Stemmed words without marketing words and those of the site's brand, sorted."""
    found = F.transform(words(x, stop), stem)
    return F.array_sort(F.array_except(F.array_distinct(F.filter(found, lambda w: ~w.isin(marketing))), brand))


def quantities(x: Column) -> Column:
    """Sizes with their unit, each unit under one name, distinct and sorted."""
    text = F.lower(clean_text(x))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(UNIT_PATTERN), F.lit(1)).alias("q"), F.regexp_extract_all(text, F.lit(UNIT_PATTERN), F.lit(2)).alias("u"))
    return F.array_sort(F.array_distinct(F.transform(found, lambda m: F.concat(m["q"], F.coalesce(mapped(m["u"], UNIT_NAMES), m["u"])))))


def alias_hit(alias: Column, blob: Column) -> Column:
    """Whether a whole word or phrase stands in a text."""
    return F.coalesce((alias != "") & F.regexp_like(blob, F.concat(F.lit(r"\b"), F.regexp_replace(alias, r"([^a-zA-Z0-9 ])", r"\\$1"), F.lit(r"\b"))), F.lit(False))


def detect_terms(x: Column, terms: list[str], limit: int = 15) -> Column:
    """The terms that a text holds, in the order of the list."""
    return F.slice(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(x), t)), 1, limit)


def descriptor_phrases(x: Column, pattern: str, edges: list[str], limit: int = 6) -> Column:
    """Distinct phrases of 5 to 50 letters that a pattern finds and that neither begin nor end with a stop word."""
    found = F.transform(F.regexp_extract_all(F.lower(x), F.lit(pattern), F.lit(0)), lambda v: F.trim(v))
    kept = F.filter(found, lambda p: F.length(p).between(5, 50) & ~F.split(p, " ")[0].isin(edges) & ~F.element_at(F.split(p, " "), -1).isin(edges))
    return F.slice(F.array_distinct(kept), 1, limit)


def cta_label(x: Column) -> Column:
    """A call to action without arrows; empty if longer than 90, with one spelling for the common ones."""
    text = clean_text(F.regexp_replace(F.coalesce(clean_markup_text(x), F.lit("")), "[↗⤓]", ""))
    return F.when(F.length(text) > 90, "").otherwise(F.coalesce(mapped(F.lower(text), CTA_LABELS), text))


def word_pairs(x: Column) -> Column:
    """Words of four letters or more and pairs of such words that follow each other."""
    found = F.regexp_extract_all(F.lower(x), F.lit("[a-z]{4,}"), F.lit(0))
    pairs = F.when(F.size(found) > 1, F.transform(F.sequence(F.lit(1), F.size(found) - 1), lambda i: F.concat(F.element_at(found, i), F.lit(" "), F.element_at(found, i + 1)))).otherwise(F.array().cast("array<string>"))
    return F.concat(found, pairs)


def collection_name(name: Column, seo_title: Column, handle: Column) -> Column:
    """The name unless it looks like a product code, else the title without its last part, else the handle as a title."""
    own = clean_markup_text(name)
    first = F.trim(F.regexp_replace(F.coalesce(clean_markup_text(seo_title), F.lit("")), r"\s*[|–-]\s*[^|–-]+$", ""))
    slug = F.initcap(clean_text(F.translate(handle, "-_", "  ")))
    code = F.regexp_like(own, F.lit(r"(?i)^[A-Z0-9]{1,6}\s*[-–]\s*[A-Z0-9]+\s*$"))
    return F.when(own.isNotNull() & ~code, own).when(F.length(first) > 3, first).otherwise(F.coalesce(slug, own))


def camel_words(x: Column) -> Column:
    """camelCase to words."""
    return F.lower(F.regexp_replace(x, "(?<=[a-z])(?=[A-Z])", " "))


def word_pattern(words_: list[str]) -> str:
    return r"\b(?:" + "|".join(map(re.escape, words_)) + r")\b"
