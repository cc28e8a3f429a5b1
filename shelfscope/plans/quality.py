"""Completeness and consistency of what is extracted from pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import quality as Q
from ..functions import rules as R
from ..operators.elements import held
from ..registry import query
from ..sources.catalog import table
from .crawl import _BLOCK_RULES, _VISIBLE
from .page_types import _TYPES_SQL, KEYS, page_types_of, typed_pages

#: Facts of a page in SQL that both engines read, from low (its html in lower case), visible, product_links, price_texts, kind and blocked.
FACTS = {
    "success": "low <> ''", "status": "CASE WHEN blocked THEN 403 ELSE 200 END", "content": "visible > 0", "products": "CASE WHEN kind = 'product' THEN 1 ELSE product_links END", "unlinked": "0.0", "unimaged": "CASE WHEN images < product_links THEN 1.0 - images / CAST(product_links AS DOUBLE) ELSE 0.0 END",
    "unpriced": "CASE WHEN price_texts < product_links THEN 1.0 - price_texts / CAST(product_links AS DOUBLE) ELSE 0.0 END", "unstocked": "CASE WHEN low LIKE '%in stock%' OR low LIKE '%sold out%' THEN 0.0 ELSE 1.0 END", "named": "h1 <> ''", "counted": "low LIKE '%products</%' OR product_links > 0", "ranged": "price_texts > 0", "summed": "description <> '' OR h1 <> ''",
    "site": "title <> ''", "hero": "h1 <> ''", "featured": "product_links > 0", "shop": "product_links > 0 OR low LIKE '%cart%'", "said": "low LIKE '%description%'", "benefits": "low LIKE '%benefit%' OR low LIKE '%ingredients%'", "category": "links > 0",
}
_ERRORS = "(" + " OR ".join(f"lower(title || ' ' || h1) LIKE '%{w}%'" for w in Q.ERROR_WORDS) + ")"


@query(f"""WITH {_TYPES_SQL}, base AS (SELECT t.origin, t.id, t.low, t.page_type AS kind, t.product_links, t.price_texts, s.visible, s.kind IS NOT NULL AS blocked, trim(coalesce(regexp_extract(t.raw, '(?i)<title>([^<]*)', 1), '')) AS title, trim(coalesce(regexp_extract(t.raw, '(?i)<h1[^>]*>([^<]*)', 1), '')) AS h1, '' AS description,
       len(regexp_extract_all(t.low, '<img[ >]')) AS images, len(regexp_extract_all(t.low, '<h2[ >]')) AS sections, len(regexp_extract_all(t.low, '<(?:button|form)[ >]')) AS buttons, len(regexp_extract_all(t.low, '<option[ >]')) AS variants, len(regexp_extract_all(regexp_extract(t.low, '(?s)<nav[^>]*>(.*?)</nav>', 1), '<a ')) AS links
    FROM t5 t JOIN (SELECT origin, id, visible, CASE {_BLOCK_RULES} END AS kind FROM (SELECT *, {_VISIBLE} AS visible FROM typed_pages)) s USING (origin, id)),
held AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in FACTS.items())}, {_ERRORS} AS error_words FROM base)
SELECT origin, id, kind, {Q.graded()['hundredths']}::INT / 100.0::DOUBLE AS score, array_to_string(list_filter([{', '.join(Q.reasons(3))}], lambda x: x IS NOT NULL), ',') AS missing, array_to_string(list_filter([{', '.join(Q.reasons(4))}], lambda x: x IS NOT NULL), '; ') AS warnings FROM held""")
def extraction_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every page's extraction with what is missing and warned of, by the deductions for its type."""
    pages = typed_pages(spark, sf_dir)
    html = F.col("html")
    text = lambda pattern: F.coalesce(M.one(html, pattern), F.lit(""))
    seen = pages.select(
        *KEYS, "url", "html", F.lower(html).alias("low"), R.visible_length(html).alias("visible"), R.page_block(html).isNotNull().alias("blocked"), text("(?i)<title>([^<]*)").alias("title"), text("(?i)<h1[^>]*>([^<]*)").alias("h1"), F.coalesce(M.meta(html, "description"), F.lit("")).alias("description"),
        F.regexp_count(F.lower(html), F.lit("<img[ >]")).alias("images"), F.regexp_count(F.lower(html), F.lit("<h2[ >]")).alias("sections"), F.regexp_count(F.lower(html), F.lit("<(?:button|form)[ >]")).alias("buttons"), F.regexp_count(F.lower(html), F.lit("<option[ >]")).alias("variants"),
        F.regexp_count(F.regexp_extract(F.lower(html), r"(?s)<nav[^>]*>(.*?)</nav>", 1), F.lit("<a ")).alias("links"),
    )
    told = [c for c in seen.columns if c not in (*KEYS, "url", "html")]
    rows = page_types_of(seen, KEYS, told).select(*KEYS, *told, F.col("page_type").alias("kind"), "product_links", "price_texts")
    facts = held(rows, **{c: F.expr(x) for c, x in FACTS.items()}, error_words=F.expr(_ERRORS))
    listed = lambda place: F.array_compact(F.array(*[F.expr(x) for x in Q.reasons(place)]))
    return facts.select(*KEYS, "kind", (F.expr(Q.graded()["hundredths"]).cast("int") / 100.0).alias("score"), F.array_join(listed(3), ",").alias("missing"), F.array_join(listed(4), "; ").alias("warnings"))


_SITE = "'https://' || replace(lower(p_brand), '#', '') || CASE p_size % 4 WHEN 0 THEN '.co.uk' WHEN 1 THEN '.de' WHEN 2 THEN '.com' ELSE '.pk' END || '/p/1'"
_TLD = "CASE p_size % 4 WHEN 0 THEN 'GBP' WHEN 1 THEN 'EUR' WHEN 3 THEN 'PKR' END"
_FOUND = "CASE p_partkey % 5 WHEN 0 THEN p_retailprice * 1.04 WHEN 1 THEN p_retailprice * 1.06 WHEN 2 THEN p_retailprice WHEN 3 THEN p_size END"
_NAME = "CASE WHEN p_partkey % 7 = 0 THEN repeat(p_name || ' ', 20) ELSE p_name END"
_MONEY = "CASE WHEN p_partkey % 3 = 0 THEN 'USD' WHEN p_partkey % 3 = 1 THEN 'EUR' END"


@query(f"""WITH x AS (SELECT p_partkey AS part, p_retailprice AS stated, {_FOUND} AS found, {_TLD} AS told, {_MONEY} AS currency, {_NAME} AS name, CASE WHEN p_partkey % 11 = 0 THEN ' ' || upper(p_name) ELSE p_brand END AS site FROM part),
y AS (SELECT *, abs(stated - found) / greatest(stated, 0.01) <= 0.05 AS agrees, currency = told AS plausible, length(name) > 120 AS long, length(name) <= 120 AND lower(trim(name)) = lower(trim(site)) AS same FROM x)
SELECT part, agrees AS price_consistent, plausible AS currency_plausible, long OR same AS suspicious_name, array_to_string(list_filter([CASE WHEN NOT agrees THEN 'price_mismatch' END, CASE WHEN NOT plausible AND currency = 'USD' THEN 'currency_likely_wrong' END, CASE WHEN long THEN 'product_name_too_long' END, CASE WHEN same THEN 'product_name_equals_site_name' END], lambda v: v IS NOT NULL), ',') AS flags FROM y""")
def data_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated against found prices, currencies against domains, and names against the site's, of every part."""
    part = table(spark, sf_dir, "part")
    site = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.col("p_brand"))
    found = Q.consistency(F.expr(_SITE), F.col("p_retailprice"), F.expr(_FOUND).cast("double"), F.expr(_MONEY), F.expr(_NAME), site)
    return part.select(F.col("p_partkey").alias("part"), found.alias("x")).select("part", "x.price_consistent", "x.currency_plausible", "x.suspicious_name", F.array_join("x.flags", ",").alias("flags"))


