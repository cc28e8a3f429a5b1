"""Topics of articles, kinds of products and collections: written cases over the whole table of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import topics as T
from ..registry import query
from .rules import _split, given, wanted

ARTICLES, ARTICLES_W = _split([
    ("How to pick a lamp | Lights", "plain text", True, "informational", "top_of_funnel", "how to pick a lamp", "how_to", ""), ("Best lamps of the year", "compare them", True, "commercial", "bottom_of_funnel", "best lamps of the year", "product", ""), ("Why light matters", "order now at checkout", False, "transactional", "top_of_funnel", "why light matters", "education", ""),
    ("A vs B - review", "online casino and 1WIN", False, "commercial", "middle_of_funnel", "a vs b", "product", "casino,1win"), ("Morning routine", "x", False, "informational", "top_of_funnel", "morning routine", "lifestyle", ""), ("Lamps", None, True, "informational", "top_of_funnel", "lamps", "general", ""),
], 3)


@query(wanted("intent, stage, keyword, topic, spam", ARTICLES_W))
def article_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search intent, funnel stage, target keyword and topic of articles, and words that tell of injected spam."""
    rows = given(spark, sf_dir, "title string, text string, products boolean", ARTICLES)
    title, text = F.col("title"), F.col("text")
    return rows.select("part", T.search_intent(title, text).alias("intent"), T.funnel_stage(title, F.col("products")).alias("stage"), T.target_keyword(title).alias("keyword"), T.topic(title).alias("topic"), F.array_join(T.spam_words(F.coalesce(text, F.lit(""))), ",").alias("spam"))


ALIASES = {"kitchen": ["blender", "kettle", "air fryer"], "lighting": ["lamp", "bulb"], "climate": ["fan", "air conditioner", "air purifier"]}
RULES = [(r"\bface\s*serum\b|\bserum\b", "Skincare", "Serum"), (r"\bperfume\b|\beau\s*de\b", "Fragrance", "Fragrance"), (r"\bnail\s*polish\b", "Nail Care", "Nail Polish")]
THINGS, THINGS_W = _split([
    ("Air Fryer 5L", "great with a lamp and bulb", "https://s/collections/kitchen-lamp/", "Fans", ["serum"], "", "", "kitchen", "lighting", "Skincare", "Serum", "Skincare"), ("Blue thing", "a lamp for you", "https://s/collections/all", "Fan club", [], "eau de nil", "Decor", "lighting", "climate", "Fragrance", "Fragrance", "Decor"),
    ("Fan lamp", "", "https://s/collections/x", None, None, None, None, "lighting", None, None, None, "X"), ("Plain", "nothing", None, "Air conditioner sale", ["nail polish"], "x", " ", None, "climate", "Nail Care", "Nail Polish", "Nail Care"), (None, None, None, None, None, "y" * 200 + " serum", None, None, None, None, None, None),
], 7)


@query(wanted("kind, shelf, category, type, chosen", THINGS_W))
def thing_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of a product (by its name first), of a collection (by its slug first), and category and type by ordered patterns with their fallbacks."""
    rows = given(spark, sf_dir, "name string, text string, url string, title string, tags array<string>, body string, own string", THINGS)
    found = T.first_rule(F.col("name"), F.col("tags"), F.col("body"), RULES)
    handle = F.regexp_extract(F.coalesce("url", F.lit("")), "/collections/([^/?#]+)", 1)
    return rows.select("part", T.product_label(F.col("name"), F.col("text"), aliases=ALIASES).alias("kind"), T.collection_label(F.col("url"), F.col("title"), ALIASES).alias("shelf"), found["category"].alias("category"), found["type"].alias("type"), T.chosen_category(F.col("own"), found["category"], handle).alias("chosen"))
