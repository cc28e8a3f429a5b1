"""Money and date functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import mapped

# Currencies by domain ending, by locale in the path, by sign, and the codes that texts write out, in order.
TLD_CURRENCY = {
    "com.pk": "PKR", "com.au": "AUD", "com.sg": "SGD", "com.hk": "HKD", "com.mx": "MXN", "com.br": "BRL", "co.uk": "GBP", "co.in": "INR", "co.nz": "NZD", "co.za": "ZAR", "co.ke": "KES",
    "pk": "PKR", "in": "INR", "ae": "AED", "sa": "SAR", "de": "EUR", "fr": "EUR", "it": "EUR", "es": "EUR", "nl": "EUR", "be": "EUR", "at": "EUR", "pt": "EUR", "ie": "EUR", "fi": "EUR", "gr": "EUR",
    "jp": "JPY", "cn": "CNY", "kr": "KRW", "sg": "SGD", "hk": "HKD", "nz": "NZD", "ca": "CAD", "mx": "MXN", "br": "BRL", "ng": "NGN", "gh": "GHS", "eg": "EGP", "za": "ZAR", "ke": "KES", "bd": "BDT", "lk": "LKR",
    "np": "NPR", "my": "MYR", "th": "THB", "id": "IDR", "ph": "PHP", "vn": "VND", "tr": "TRY", "ru": "RUB", "ch": "CHF", "se": "SEK", "no": "NOK", "dk": "DKK", "pl": "PLN",
}
LOCALE_CURRENCY = {
    "en-pk": "PKR", "en-in": "INR", "en-gb": "GBP", "en-au": "AUD", "en-ca": "CAD", "en-ae": "AED", "en-sa": "SAR", "en-eu": "EUR", "en-sg": "SGD", "en-nz": "NZD", "en-hk": "HKD", "en-mx": "MXN",
    "de-de": "EUR", "fr-fr": "EUR", "it-it": "EUR", "es-es": "EUR", "nl-nl": "EUR", "ja-jp": "JPY", "zh-cn": "CNY", "ko-kr": "KRW",
}
SIGNS = {"ca$": "CAD", "a$": "AUD", "nz$": "NZD", "hk$": "HKD", "s$": "SGD", "£": "GBP", "€": "EUR", "₹": "INR", "₨": "PKR", "¥": "JPY", "₩": "KRW", "﷼": "SAR", "د.إ": "AED", "฿": "THB", "₺": "TRY"}
CODES = ["PKR", "INR", "AED", "SAR", "BDT", "LKR", "NPR", "MYR", "THB", "IDR", "PHP", "VND", "NGN", "KES", "GHS", "EGP", "ZAR", "CAD", "AUD", "NZD", "SGD", "HKD", "MXN", "BRL", "JPY", "CNY", "KRW", "GBP", "EUR", "CHF", "SEK", "NOK", "DKK", "PLN", "TRY", "RUB", "USD"]
PLAN_SIGNS = {"$": "$", "€": "EUR", "£": "GBP", "₹": "INR", "₨": "PKR", "usd": "USD", "eur": "EUR", "gbp": "GBP", "pkr": "PKR", "rs": "PKR", "rs.": "PKR"}


def url_currency(url: Column) -> Column:
    """By a locale in the path, else the longest known ending of the host, else a two-letter first label of three or more."""
    low = F.lower(F.coalesce(url, F.lit("")))
    host = F.regexp_extract(low, r"^[a-z]+://([^/?#]*)", 1)
    labels = F.split(host, r"\.")
    two, one = F.regexp_extract(host, r"\.([^.]+\.[^.]+)$", 1), F.regexp_extract(host, r"\.([^.]+)$", 1)
    locale = F.filter(F.array(*[F.lit(k) for k in LOCALE_CURRENCY]), lambda k: F.contains(low, F.concat(F.lit("/"), k, F.lit("/"))))
    first = F.when((F.size(labels) >= 3) & (F.length(labels[0]) == 2), mapped(labels[0], TLD_CURRENCY))
    return F.coalesce(mapped(F.get(locale, F.lit(0)), LOCALE_CURRENCY), mapped(two, TLD_CURRENCY), mapped(one, TLD_CURRENCY), first)


def _sign(low: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(low, F.lit(s)), c) for s, c in SIGNS.items()])


def _code(x: Column, codes: list[str]) -> Column:
    return F.coalesce(*[F.when(F.regexp_like(x, F.lit(rf"(?i)\b{c}\b")), c) for c in codes])


def sign_currency(x: Column) -> Column:
    """Of a price text: by sign, else by code, else Rs."""
    low = F.lower(x)
    return F.coalesce(_sign(low), _code(x, CODES), F.when(F.regexp_like(low, F.lit(r"\brs\.?\s")) | F.startswith(low, F.lit("rs")), "PKR"))


def text_currency(x: Column, url: Column) -> Column:
    """Of free text: sign, code, Rs; a dollar is told by the url, else USD; without any the url alone decides."""
    low = F.lower(F.coalesce(x, F.lit("")))
    dollar = F.contains(low, F.lit("$")) | F.regexp_like(low, F.lit(r"\busd\b"))
    return F.coalesce(_sign(low), _code(low, [c for c in CODES if c != "USD"]), F.when(F.regexp_like(low, F.lit(r"\brs\.?\s")), "PKR"), url_currency(url), F.when(dollar, "USD"))


def merged_currency(x: Column) -> Column:
    """The first of the spellings that a price text holds: Rs or PKR, dollar, pound, euro."""
    x = F.coalesce(x, F.lit(""))
    holds = lambda *parts: F.lit(False) if not parts else F.contains(x, F.lit(parts[0])) | (holds(*parts[1:]) if parts[1:] else F.lit(False))
    return F.when(holds("Rs", "PKR"), "PKR").when(holds("$", "USD"), "USD").when(holds("£", "GBP"), "GBP").when(holds("€", "EUR"), "EUR")


def price_number(x: Column) -> Column:
    """The first number of a text, commas away; 0 is no price."""
    return F.nullif(F.regexp_extract(F.replace(x, F.lit(","), F.lit("")), r"[0-9]+(?:\.[0-9]+)?", 0).try_cast("double"), F.lit(0.0))


def price_value(json: Column, keys: tuple[str, ...] = ("current", "amount", "value", "price", "min")) -> Column:
    """Of a price object (JSON) the first key that gives a price, else its raw text."""
    field = lambda k: price_number(F.get_json_object(json, f"$.{k}"))
    return F.coalesce(*map(field, keys), field("priceTextRaw"), field("text"), F.when(~F.startswith(F.trim(json), F.lit("{")), price_number(json)))


def price_text(x: Column, url: Column) -> Column:
    """raw, amount, currency of a price text; null if empty, amount null if it has none or is 0."""
    raw = F.trim(F.regexp_replace(x, r"\s+", " "))
    bare = F.regexp_replace(F.regexp_replace(raw, r"(?i)[£€₹₨¥₩﷼฿₺]|\b(?:" + "|".join(CODES) + r")\b|\brs\.?\b", ""), r"[,\s]+", "")
    amount = F.nullif(F.regexp_extract(bare, r"[0-9]+(?:\.[0-9]{1,2})?", 0).try_cast("double"), F.lit(0.0))
    currency = F.coalesce(sign_currency(raw), F.when(F.contains(raw, F.lit("$")), F.coalesce(url_currency(url), F.lit("USD"))))
    return F.when(F.coalesce(raw, F.lit("")) != "", F.struct(raw.alias("raw"), amount.alias("amount"), currency.alias("currency")))


_MONEY = r"(?i)(?:([$€£₹₨]|USD|EUR|GBP|PKR|Rs\.?)\s?([0-9][0-9,]*(?:\.[0-9]+)?))|(?:([0-9][0-9,]*(?:\.[0-9]+)?)\s?([$€£]|USD|EUR|GBP|PKR))"
_PERIOD = r"(?i)/\s*(mo(?:nth)?|yr|year|annual(?:ly)?|lifetime|one[- ]?time|user|seat|site)s?\b"


def plan_money(x: Column) -> Column:
    """currency, amount, period of the first money in a plan's text; sign before or after."""
    part = lambda k: F.regexp_extract(x, _MONEY, k)
    sign = F.lower(F.concat(part(1), part(4)))
    amount = F.replace(F.concat(part(2), part(3)), F.lit(","), F.lit("")).try_cast("double")
    return F.struct(F.coalesce(mapped(sign, PLAN_SIGNS), F.nullif(sign, F.lit(""))).alias("currency"), amount.alias("amount"), F.nullif(F.lower(F.regexp_extract(x, _PERIOD, 1)), F.lit("")).alias("period"))


def node_money(json: Column) -> Column:
    """amount (0 is none) and currency (USD unless named) of a storefront's money node."""
    return F.struct(F.nullif(F.get_json_object(json, "$.amount").try_cast("double"), F.lit(0.0)).alias("amount"), F.coalesce(F.nullif(F.get_json_object(json, "$.currencyCode"), F.lit("")), F.lit("USD")).alias("currency"))


def clamped(x: Column) -> Column:
    """A score within 0 and 100, 0 for none."""
    return F.least(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)), F.lit(100.0))


# Dates.


def next_scan(cadence: Column, at: Column) -> Column:
    """The next scan of a timestamp; a month after a day that the next month lacks overflows into the one after.  once: null; others raise."""
    low, day = F.lower(cadence), at.cast("date")
    days = mapped(low, {"daily": "1", "2d": "2", "3d": "3", "5d": "5", "weekly": "7"}).cast("int")
    first = F.date_add(F.last_day(day), 1)
    month = F.date_add(first, F.dayofmonth(day) - 1)
    bad = F.raise_error(F.concat(F.lit("unsupported cadence: "), F.coalesce(cadence, F.lit("null")))).cast("date")
    return F.when(days.isNotNull(), F.date_add(day, days)).when(low == "monthly", month).when(low == "once", F.lit(None).cast("date")).otherwise(bad)


def relative_day(at: Column, now: Column) -> Column:
    """today, yesterday, 3 days ago, last week, 4 weeks ago; for times to come today, tomorrow, in 3 days, in 2 weeks."""
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0 + 0.5)
    ahead = -days
    say = lambda n, text: F.concat(n.cast("string"), F.lit(text))
    past = F.when(days == 1, "yesterday").when(days < 7, say(days, " days ago")).when(days < 14, "last week").otherwise(say(F.floor(days / 7.0 + 0.5), " weeks ago"))
    future = F.when(ahead == 1, "tomorrow").when(ahead < 14, F.concat(F.lit("in "), say(ahead, " days"))).otherwise(F.concat(F.lit("in "), say(F.floor(ahead / 7.0 + 0.5), " weeks")))
    return F.when(at.isNull(), F.lit(None).cast("string")).when(days == 0, "today").when(days > 0, past).otherwise(future)


def cadence_label(per_week: Column) -> Column:
    """Runs a week as a label."""
    days = F.floor(F.try_divide(F.lit(7.0), per_week) + 0.5)
    return F.when(F.coalesce(per_week, F.lit(0.0)) <= 0, "periodic").when(days <= 1, "daily").when(days == 7, "weekly").when(days >= 28, "monthly").otherwise(F.concat(F.lit("every "), days.cast("string"), F.lit(" days")))


def trial_state(ends: Column, paid: Column, now: Column) -> Column:
    """paid, trial or expired."""
    return F.when(F.coalesce(paid, F.lit(False)), "paid").when(ends < now, "expired").when(ends.isNull(), "free").otherwise("trial")
