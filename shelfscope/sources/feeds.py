"""Product feeds: what analyzers write about a product, in one canonical form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean_text, html_to_text, truncate
from ..functions.money import merged_currency
from .catalog import rnd

_PRICE = "struct<currency:string,current:string,amount:string,value:string,compareAt:string,compareAtPrice:string,comparePrice:string,priceTextRaw:string,text:string>"
#: One document of a page and a product; numbers are read as texts, as feeds write them either way.
SCHEMA = f"""page struct<url:string,pageType:string>, product struct<name:string,title:string,handle:string,productId:string,productUrl:string,url:string,imageUrl:string,price:{_PRICE},currentPrice:string,comparePrice:string,currency:string,
allPrices:array<string>,availability:string,stock:struct<label:string,status:string,inStock:boolean>,description:struct<text:string,html:string>,shortDescription:string,category:string,vendor:string,tags:array<string>,variants:array<struct<id:string,title:string,price:string,available:boolean>>,
related:array<struct<name:string,url:string>>>""".replace("\n", "")

#: Wordings of links that are no products.
CTA_NAMES = r"(?i)^(?:(?:explore|shop|view|see|browse|discover)\b.{0,40}|shop now|view all|see all|learn more|read more)$"
IN_STOCK, OUT_OF_STOCK = r"in stock|in_stock|instock|available", r"out of stock|out_of_stock|sold out|unavailable"


def _some(x: Column) -> Column:
    """The text, cleaned; null if empty."""
    return F.nullif(clean_text(x), F.lit(""))


def number(x: Column) -> Column:
    return F.nullif(F.replace(F.regexp_extract(x, "[0-9][0-9,]*(?:\\.[0-9]+)?", 0), F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def canonical_price(p: Column) -> Column:
    """currency, current, compare_at, on_sale, discount_percent, raw: the price object first, then the product's own fields, then its raw text."""
    price = p["price"]
    raw = F.coalesce(_some(price["priceTextRaw"]), _some(price["text"]))
    current = F.coalesce(number(F.coalesce(_some(price["current"]), _some(price["amount"]), price["value"])), number(p["currentPrice"]), number(raw))
    named = F.coalesce(number(F.coalesce(_some(price["compareAt"]), _some(price["compareAtPrice"]), price["comparePrice"])), number(p["comparePrice"]))
    listed = F.filter(F.transform(p["allPrices"], number), lambda x: x.isNotNull())
    compare = F.coalesce(named, F.when((F.size(listed) >= 2) & (F.array_max(listed) > current), F.array_max(listed)))
    sale = F.coalesce(compare > current, F.lit(False))
    return F.struct(
        F.coalesce(_some(price["currency"]), _some(p["currency"]), merged_currency(raw)).alias("currency"), rnd(current, 2).alias("current"), rnd(compare, 2).alias("compare_at"), sale.alias("on_sale"), F.when(sale, rnd((compare - current) / compare * 100, 1)).alias("discount_percent"), raw.alias("raw")
    )


def canonical_stock(p: Column) -> Column:
    """label and in_stock: an object as it is, a text by its words; "unavailable" holds "available" and counts as in stock."""
    words = _some(p["availability"])
    low = F.lower(words)
    told = F.when(F.regexp_like(low, F.lit(IN_STOCK)), True).when(F.regexp_like(low, F.lit(OUT_OF_STOCK)), False)
    return F.struct(F.coalesce(_some(p["stock"]["label"]), _some(p["stock"]["status"]), words).alias("label"), F.coalesce(p["stock"]["inStock"], told).alias("in_stock"))


def stock_status(x: Column) -> Column:
    """The analyzers' status of a text: out_of_stock, in_stock, backorder (stock unknown) or unknown."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(F.regexp_like(low, F.lit("out of stock|out_of_stock|sold out|unavailable")), "out_of_stock").when(F.regexp_like(low, F.lit("in stock|in_stock|instock|available")), "in_stock").when(F.regexp_like(low, F.lit("back ?order|pre-?order")), "backorder").otherwise("unknown")


def category_name(x: Column) -> Column:
    """Slugs as titles; what is longer than 80 is a tagline, not a category."""
    name = _some(x)
    return F.when(F.length(name) > 80, None).when(F.regexp_like(name, F.lit("^[a-z0-9]+(?:[-_][a-z0-9]+)*$")), F.initcap(F.translate(name, "-_", "  "))).otherwise(name)


def product_name(x: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(clean_text(x), r"(?i)\s*\((?:opens?|link opens?)[^)]*\)\s*$", "")), F.lit(""))


def canonical_products(documents: DataFrame) -> DataFrame:
    """Documents in SCHEMA as canonical products.

    Links that only call to action, and products with neither name nor url, are left out; a product
    whose url is that of a page that is no product page has none.
    """
    p, page = F.col("product"), F.col("page")
    price, stock = canonical_price(p), canonical_stock(p)
    name = product_name(F.coalesce(_some(p["name"]), p["title"]))
    bare = lambda u: F.regexp_replace(F.regexp_replace(u, "#.*$", ""), "/+$", "")
    url = _some(bare(F.coalesce(_some(p["productUrl"]), p["url"])))
    own = F.when((url == bare(page["url"])) & (F.coalesce(page["pageType"], F.lit("")) != "product"), None).otherwise(url)
    text = F.coalesce(_some(p["description"]["text"]), _some(html_to_text(p["description"]["html"])), _some(p["shortDescription"]))
    rows = documents.select(
        name.alias("name"), _some(p["handle"]).alias("handle"), own.alias("url"), price.alias("price"), stock.alias("stock"), truncate(text, 2000).alias("description"), category_name(p["category"]).alias("category"), _some(p["vendor"]).alias("vendor"), p["tags"].alias("tags"),
        F.transform(p["variants"], lambda v: F.struct(v["id"].alias("id"), _some(v["title"]).alias("title"), number(v["price"]).alias("price"), v["available"].alias("available"))).alias("variants"),
        F.transform(F.slice(p["related"], 1, 10), lambda r: F.struct(_some(r["name"]).alias("name"), bare(r["url"]).alias("url"))).alias("related"), page["url"].alias("page_url"), page["pageType"].alias("page_type"), _some(p["productId"]).alias("product_id"), p["imageUrl"].alias("image"),
    )
    cta = F.regexp_like(F.coalesce("name", F.lit("")), F.lit(CTA_NAMES)) & F.col("price.current").isNull() & F.col("handle").isNull() & F.col("product_id").isNull()
    return rows.where(~cta & (F.col("name").isNotNull() | F.col("url").isNotNull()))


def card_products(products: DataFrame) -> DataFrame:
    """The short form for listings: counts instead of lists, and no stock, which cards do not tell."""
    return products.select("name", "handle", "url", "price", F.lit(None).cast("boolean").alias("in_stock"), F.coalesce(F.size("variants"), F.lit(0)).alias("variant_count"), F.coalesce(F.size("tags"), F.lit(0)).alias("tag_count"))
