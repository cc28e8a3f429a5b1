"""Regional stores and currencies that a page offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.elements import attribute, first, gathered, held, inside, text_inside
from .text import mapped

# Currency and name by country.
CURRENCIES = {
    "US": "USD", "GB": "GBP", "UK": "GBP", "EU": "EUR", "IE": "EUR", "DE": "EUR", "FR": "EUR", "ES": "EUR", "IT": "EUR", "NL": "EUR", "BE": "EUR", "AT": "EUR", "PT": "EUR", "FI": "EUR", "GR": "EUR", "CA": "CAD", "AU": "AUD", "NZ": "NZD", "JP": "JPY", "CN": "CNY", "HK": "HKD", "SG": "SGD",
    "IN": "INR", "PK": "PKR", "BD": "BDT", "LK": "LKR", "AE": "AED", "SA": "SAR", "QA": "QAR", "KW": "KWD", "BH": "BHD", "OM": "OMR", "TR": "TRY", "RU": "RUB", "UA": "UAH", "PL": "PLN", "CZ": "CZK", "HU": "HUF", "RO": "RON", "SE": "SEK", "NO": "NOK", "DK": "DKK", "CH": "CHF", "ZA": "ZAR",
    "NG": "NGN", "EG": "EGP", "KE": "KES", "MA": "MAD", "BR": "BRL", "MX": "MXN", "AR": "ARS", "CL": "CLP", "CO": "COP", "PE": "PEN", "KR": "KRW", "TH": "THB", "MY": "MYR", "ID": "IDR", "PH": "PHP", "VN": "VND", "IL": "ILS", "TW": "TWD",
}
NAMES = {
    "US": "United States", "GB": "United Kingdom", "UK": "United Kingdom", "IE": "Ireland", "DE": "Germany", "FR": "France", "ES": "Spain", "IT": "Italy", "NL": "Netherlands", "BE": "Belgium", "AT": "Austria", "PT": "Portugal", "FI": "Finland", "GR": "Greece", "CA": "Canada", "AU": "Australia",
    "NZ": "New Zealand", "JP": "Japan", "CN": "China", "HK": "Hong Kong", "SG": "Singapore", "IN": "India", "PK": "Pakistan", "BD": "Bangladesh", "LK": "Sri Lanka", "AE": "United Arab Emirates", "SA": "Saudi Arabia", "QA": "Qatar", "KW": "Kuwait", "BH": "Bahrain", "OM": "Oman", "TR": "Turkey",
    "RU": "Russia", "UA": "Ukraine", "PL": "Poland", "CZ": "Czechia", "HU": "Hungary", "RO": "Romania", "SE": "Sweden", "NO": "Norway", "DK": "Denmark", "CH": "Switzerland", "ZA": "South Africa", "NG": "Nigeria", "EG": "Egypt", "KE": "Kenya", "MA": "Morocco", "BR": "Brazil", "MX": "Mexico",
    "AR": "Argentina", "CL": "Chile", "CO": "Colombia", "PE": "Peru", "KR": "South Korea", "TH": "Thailand", "MY": "Malaysia", "ID": "Indonesia", "PH": "Philippines", "VN": "Vietnam", "IL": "Israel", "TW": "Taiwan", "EU": "European Union",
}
#: Signs that only one currency has, in order.
SIGNS = {"€": "EUR", "£": "GBP", "₹": "INR", "د.إ": "AED", "﷼": "SAR", "₦": "NGN", "₩": "KRW", "₪": "ILS", "฿": "THB", "₺": "TRY"}
_CODES = sorted(set(CURRENCIES.values()))


def _known(x: Column) -> Column:
    return F.when(x.isin(_CODES), x)


def country_of_url(url: Column) -> Column:
    """By a locale or country in the path, a two-letter first label, or the domain's ending."""
    full = F.lower(F.when(F.regexp_like(url, F.lit("^https?://")), url).otherwise(F.concat(F.lit("https://"), F.coalesce(url, F.lit("")))))
    host, path = F.regexp_extract(full, "^https?://([^/?#]*)", 1), F.regexp_extract(full, "^https?://[^/?#]*([^?#]*)", 1)
    named = lambda x: F.when(F.upper(x).isin(list(NAMES)), F.upper(x))
    labels = F.split(host, r"\.")
    locale = F.upper(F.nullif(F.regexp_extract(path, "/[a-z]{2}-([a-z]{2})(?:/|$)", 1), F.lit("")))
    return F.coalesce(locale, named(F.regexp_extract(path, "/([a-z]{2})(?:/|$)", 1)), F.when((F.size(labels) >= 3) & (F.length(labels[0]) == 2), named(labels[0])), named(F.element_at(labels, -1)))


def visible_currency(text: Column) -> Column:
    """The code that stands beside a number most often (the earlier one on ties), else the first sign that only one currency has."""
    pattern = r"\d[\d.,]{0,15}\s*([A-Z]{3})\b|\b([A-Z]{3})\s*\d[\d.,]{0,15}"
    both = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    codes = F.filter(both, lambda c: c.isin(_CODES))
    counted = F.transform(F.array_distinct(codes), lambda c: F.struct(F.size(F.filter(codes, lambda x: x == c)).alias("n"), (-F.array_position(codes, c)).alias("at"), c.alias("code")))
    return F.coalesce(F.array_max(counted)["code"], *[F.when(F.contains(text, F.lit(s)), c) for s, c in SIGNS.items()])


def stores(pages: DataFrame, toks: DataFrame, els: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """stores_in() of pages (url, html), as tables, whose tokens and elements are given; pages of the same keys are one."""
    found = stores_in(pages.select(*keys, "url", "html").join(gathered(toks, els, keys), keys, "left"))
    return ranked_stores(found, keys), page_money(found, keys)


def ranked_stores(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rank, hreflang, country, name, url, currency, current, same_url: one row per store."""
    return found.select(*keys, F.posexplode("stores").alias("rank", "x")).select(*keys, (F.col("rank") + 1).alias("rank"), *[f"x.{c}" for c in ("hreflang", "country", "name", "url", "currency", "current", "same_url")])


def page_money(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, currency, currencies, source: one row per page."""
    offered = F.transform(F.filter("stores", lambda x: x["same_url"]), lambda x: x["currency"])
    return found.select(*keys, F.col("told.code").alias("currency"), F.array_sort(F.array_distinct(F.array_compact(F.concat(offered, F.array("told.code"))))).alias("currencies"), F.col("told.source").alias("source"))


def stores_in(rows: DataFrame) -> DataFrame:
    """``rows`` (url, html, els, texts, as page_arrays() has them) with stores, in order, and told, what holds for the page (source, code).

    The page's currency is the active one, else that of visible prices, else that of its country,
    else the shop's base.  Stores are alternates by language, options of a country list and links
    that set a country, the first of each country; exactly one is current and comes first.  All is
    told within the row of the page.
    """
    kept = [c for c in rows.columns if c not in ("html", "els", "texts")]
    blank = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    rows = held(rows, els=blank("els"), texts=blank("texts"))
    attr = lambda e, name: F.nullif(attribute(e["token"], name), F.lit(""))
    found = lambda test, value: first(F.filter(F.transform(F.filter("els", test), value), lambda x: x.isNotNull()))
    meta = lambda kind, name: lambda e: (e["tag"] == "meta") & (F.lower(attribute(e["token"], kind)) == name)
    code = lambda e: F.when(F.regexp_like(F.upper(attribute(e["token"], "content")), F.lit("^[A-Z]{3}$")), F.upper(attribute(e["token"], "content")))
    said = lambda e: text_inside(F.col("texts"), e)
    rows = held(
        rows, lang_tag=found(lambda e: e["tag"] == "html", lambda e: attr(e, "lang")), og_locale=found(meta("property", "og:locale"), lambda e: attr(e, "content")), c1=found(meta("property", "og:price:currency"), code), c2=found(meta("itemprop", "pricecurrency"), code), c3=found(meta("name", "currency"), code),
        switched=said(first("els", lambda e: F.regexp_like(e["cls"], F.lit("(?i)wcml-cs-active-currency|current-lang-currency")))), body=F.array_join(F.transform("texts", lambda t: t["text"]), " "),
    )
    shop = F.upper(F.nullif(F.regexp_extract("html", r"(?:window\.)?Shopify\.currency\s*=\s*\{[^}]*?[\"']active[\"']\s*:\s*[\"']([A-Za-z]{3})[\"']", 1), F.lit("")))
    part = lambda tag, k: F.nullif(F.get(F.split(tag, "[-_]"), F.lit(k)), F.lit(""))
    country = F.coalesce(F.upper(part(F.col("lang_tag"), 1)), F.upper(part(F.col("og_locale"), 1)), country_of_url(F.col("url")))
    rows = held(rows, language=F.coalesce(F.lower(part(F.col("lang_tag"), 0)), F.lower(part(F.col("og_locale"), 0))), own=country)
    by = [("active_currency", F.coalesce(shop, "c1", "c2", "c3", _known(F.regexp_extract(F.upper("switched"), r"\b([A-Z]{3})\b", 1)))), ("visible_currency", visible_currency(F.col("body"))), ("cctld_currency", mapped(F.col("own"), CURRENCIES)), ("base_currency", F.nullif(F.regexp_extract("html", r'"currency"\s*:\s*"([A-Z]{3})"', 1), F.lit("")))]
    rows = held(rows, told=F.coalesce(*[F.when(c.isNotNull(), F.struct(F.lit(n).alias("source"), c.alias("code"))) for n, c in by]))
    page_url, own, money = F.col("url"), F.col("own"), F.col("told.code")
    host = lambda u: F.lower(F.regexp_extract(F.when(F.regexp_like(u, F.lit("^(?:https?:)?//")), u).otherwise(F.concat(F.lit("https://"), u)), "//([^/?#]*)", 1))
    variant = lambda c: F.when(c == own, page_url).otherwise(F.concat(page_url, F.when(F.contains(page_url, F.lit("?")), "&").otherwise("?"), F.lit("country="), c))
    here = lambda c: F.coalesce(c == own, F.lit(False))
    named = lambda c: F.concat_ws("-", F.coalesce("language", F.lit("en")), c)
    usual = lambda current, c: F.when(current & money.isNotNull(), money).otherwise(mapped(c, CURRENCIES))

    def store(k: int, pos: Column, hreflang: Column, country: Column, label: Column, url: Column, currency: Column, current: Column, same_url: bool) -> Column:
        return F.struct((~current).alias("later"), F.lit(k).alias("k"), pos.alias("pos"), hreflang.alias("hreflang"), country.alias("country"), label.cast("string").alias("label"), url.alias("url"), currency.alias("currency"), current.alias("current"), F.lit(same_url).alias("same_url"))

    def alternate(x: Column) -> Column:
        near = F.coalesce(F.when(F.regexp_like(x["href"], F.lit("^(?:https?:)?//")), host(x["href"]) == host(page_url)), F.lit(False))
        current = near | here(x["country"])
        return store(0, x["pos"], x["hreflang"], x["country"], F.lit(None), x["href"], usual(current, x["country"]), current, False)

    def option(x: Column) -> Column:
        currency = F.coalesce(F.when(F.regexp_like(x["data"], F.lit("^[A-Z]{3}$")), x["data"]), F.nullif(F.regexp_extract(x["said"], r"\b([A-Z]{3})\b", 1), F.lit("")), mapped(x["country"], CURRENCIES))
        return store(1, x["pos"], named(x["country"]), x["country"], F.trim(F.regexp_replace(x["said"], r"\s*\(.*?\)\s*", " ")), variant(x["country"]), currency, here(x["country"]), True)

    link = lambda x: store(2, x["pos"], named(x["country"]), x["country"], F.lit(None), variant(x["country"]), usual(here(x["country"]), x["country"]), here(x["country"]), True)
    alternates = F.transform(F.filter("els", lambda e: (e["tag"] == "link") & F.contains(F.lower(attribute(e["token"], "rel")), F.lit("alternate"))), lambda e: F.struct(e["pos"].alias("pos"), attr(e, "hreflang").alias("hreflang"), attr(e, "href").alias("href"), F.upper(part(attr(e, "hreflang"), 1)).alias("country")))
    kind = lambda e: F.when(attribute(e["token"], "name") == "country_code", 0).when(F.contains(F.lower(attribute(e["token"], "name")), F.lit("country")), 1)
    lists = F.transform(F.filter("els", lambda e: (e["tag"] == "select") & kind(e).isNotNull()), lambda e: F.struct(kind(e).alias("kind"), e["pos"].alias("pos"), e["end"].alias("end")))
    rows = held(rows, alternates=F.filter(alternates, lambda x: x["href"].isNotNull() & (F.lower(x["hreflang"]) != "x-default") & x["country"].isNotNull()), box=F.array_min(lists))
    options = F.transform(F.filter(inside(F.col("els"), F.col("box")), lambda e: e["tag"] == "option"), lambda e: F.struct(e["pos"].alias("pos"), F.upper(F.trim(attribute(e["token"], "value"))).alias("country"), F.upper(F.coalesce(attr(e, "data-currency"), attr(e, "data-currency-code"))).alias("data"), said(e).alias("said")))
    links = F.transform(F.filter("els", lambda e: e["tag"] == "a"), lambda e: F.struct(e["pos"].alias("pos"), F.upper(F.regexp_extract(attribute(e["token"], "href"), r"[?&]country=([A-Za-z]{2})\b", 1)).alias("country")))
    rows = held(rows, options=F.coalesce(F.filter(options, lambda x: F.length(x["country"]) == 2), F.array()), links=F.filter(links, lambda x: x["country"].isin(list(NAMES))))
    rows = held(rows, every=F.concat(F.transform("alternates", alternate), F.transform("options", option), F.transform("links", link)))
    # The first of each country: alternates come first, then options, then links, each in the page's order.
    first_of = F.transform(F.array_distinct(F.transform("every", lambda x: x["country"])), lambda c: first("every", lambda x: x["country"] == c))
    rows = held(rows, firsts=F.array_sort(first_of))
    alone = F.when(own.isNotNull() | money.isNotNull(), F.array(store(3, F.lit(0), F.concat_ws("-", "language", "own"), own, F.lit(None), page_url, money, F.lit(True), False)))
    rows = held(rows, firsts=F.when(F.size("firsts") > 0, F.col("firsts")).otherwise(F.coalesce(alone, F.col("firsts"))))

    def shown(x: Column, i: Column) -> Column:
        name = F.coalesce(mapped(x["country"], NAMES), F.nullif(x["label"], F.lit("")), x["country"])
        return F.struct((i > 0).alias("later"), F.lower(name).alias("low"), x["country"].alias("country"), x["hreflang"].alias("hreflang"), name.alias("name"), x["url"].alias("url"), x["currency"].alias("currency"), (i == 0).alias("current"), x["same_url"].alias("same_url"))

    return held(rows, stores=F.array_sort(F.transform("firsts", shown))).select(*kept, "told", "stores")
