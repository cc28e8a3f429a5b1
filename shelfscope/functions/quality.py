"""How complete an extraction is, by a table of deductions, and whether what it found agrees with itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import url_currency

# Deductions.  For which kind of page (all if empty; "other" is none of the named), when, how much, what is missing, and the warning.
# A condition speaks of facts(): success, blocked, status, title, description, h1, kind, content, products, unlinked, unimaged, unpriced,
# unstocked (shares of products), named, counted, ranged, summed, site, hero, links, sections, featured, buttons, shop, said, benefits, images, variants, category.
DEDUCTIONS = [
    ("", "NOT success", 0.55, None, "Extraction failed."),
    ("", "blocked", 0.45, None, "Page was blocked or no usable HTML was returned."),
    ("", "status >= 400", 0.35, None, "HTTP status code indicates a failed or error page."),
    ("", "error_words", 0.45, None, "Fetched page appears to be an error, blocked, or security page."),
    ("", "kind IN ('', 'unknown')", 0.2, "pageType", None),
    ("", "title = ''", 0.08, "seo.title", None),
    ("", "description = ''", 0.05, "seo.metaDescription", None),
    ("", "NOT content", 0.15, "mainContent", None),
    ("product collection", "products = 0", 0.12, None, "Ecommerce page detected but products were not extracted."),
    ("collection", "NOT named", 0.08, "collection.collectionName", None),
    ("collection", "products = 0", 0.15, "collection.products", "No products extracted from collection page."),
    ("collection", "products > 0 AND unlinked > 0.5", 0.07, "collection.productUrls", None),
    ("collection", "products > 0 AND unimaged > 0.5", 0.05, "collection.productImages", "images_missing"),
    ("collection", "products > 0 AND unpriced > 0.5", 0.05, "collection.prices", None),
    ("collection", "products > 0 AND unstocked > 0.8", 0.04, "collection.availability", None),
    ("collection", "NOT counted", 0.04, "collection.productStats", None),
    ("collection", "NOT ranged", 0.04, "collection.priceRange", None),
    ("collection", "NOT summed", 0.03, "collection.collectionSummary", None),
    ("homepage", "NOT site", 0.05, "homepage.siteName", None),
    ("homepage", "NOT hero", 0.07, "homepage.heroMedia", "hero_missing"),
    ("homepage", "links = 0", 0.06, "homepage.navigation", "navigation_missing"),
    ("homepage", "sections = 0", 0.08, "homepage.sections", "sections_missing"),
    ("homepage", "sections = 1", 0.03, "homepage.sections_too_few", None),
    ("homepage", "NOT featured", 0.07, "homepage.featuredProductsOrCollections", "no_ecommerce_content_on_homepage"),
    ("homepage", "buttons = 0", 0.05, "homepage.primaryCtas", "no_ctas_detected"),
    ("homepage", "NOT shop", 0.04, "homepage.ecommerceSignals", None),
    ("other", "products > 0 AND NOT said", 0.05, "product.description", "description_missing"),
    ("other", "products > 0 AND NOT benefits", 0.06, "product.benefits_or_features", "benefits_features_missing"),
    ("other", "products > 0 AND images = 0", 0.05, "product.images", "images_missing"),
    ("other", "products > 0 AND variants = 0", 0.03, "product.variants", "variants_missing"),
    ("other", "products > 0 AND NOT category", 0.04, "product.category", "category_missing"),
]
# Words of error pages, and how far two prices may be apart.
ERROR_WORDS = ["invalid ssl certificate", "error code 526", "access denied", "just a moment", "attention required", "page not found", "404"]
NEAR, LONGEST_NAME = 0.05, 120


def applies(kinds: str, condition: str) -> str:
    """SQL: whether a deduction holds for a page."""
    named = ", ".join(f"'{k}'" for k in kinds.split() if k != "other")
    scope = "" if not kinds else "kind NOT IN ('collection', 'homepage') AND " if kinds == "other" else f"kind IN ({named}) AND "
    return f"{scope}({condition})"


def graded() -> dict[str, str]:
    """SQL, in both engines: the score in hundredths."""
    return {"hundredths": "greatest(0, 100" + "".join(f" - CASE WHEN {applies(k, c)} THEN {round(p * 100)} ELSE 0 END" for k, c, p, _, _ in DEDUCTIONS) + ")"}


def reasons(place: int) -> list[str]:
    """SQL: what is missing (3) or warned of (4), one expression by deduction; null where it does not hold."""
    return [f"CASE WHEN {applies(k, c)} THEN '{row}' END" for k, c, *rest in DEDUCTIONS if (row := rest[place - 2])]


def consistency(url: Column, stated: Column, found: Column, currency: Column, name: Column, site: Column) -> Column:
    """Whether the stated price (of structured data) and the found one agree within 5 %, whether the currency fits the url's domain, whether the name looks wrong, and what is to be flagged."""
    apart = F.abs(stated - found) / F.greatest(stated, F.lit(0.01))
    agrees = F.when(stated.isNotNull() & found.isNotNull(), apart <= NEAR)
    told = url_currency(url)
    plausible = F.when(currency.isNotNull() & told.isNotNull(), currency == told)
    low, own = F.lower(F.trim(name)), F.nullif(F.lower(F.trim(site)), F.lit(""))
    long = F.coalesce(F.length(name) > LONGEST_NAME, F.lit(False))
    same = F.coalesce(~long & (low != "") & (low == own), F.lit(False))
    flags = F.array_compact(F.array(F.when(~agrees, "price_mismatch"), F.when(~plausible & (currency == "USD"), "currency_likely_wrong"), F.when(long, "product_name_too_long"), F.when(same, "product_name_equals_site_name"), F.when(stated <= 0, "structured_data_zero_or_negative_price")))
    return F.struct(agrees.alias("price_consistent"), plausible.alias("currency_plausible"), (long | same).alias("suspicious_name"), flags.alias("flags"))
