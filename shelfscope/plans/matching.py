"""Similarity scores and matching of products, collections and pages between sites.

Candidates come from equi-joins on blocks, never from all pairs, but no pair that can reach a bar is
lost: products of one category meet by a shared word, the vendor or the price; suggestions meet by a
shared word, where a rival's products lie; pages meet by shared pairs of letters.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bigrams, jaccard, price_closeness
from ..operators import site_pairs as S
from ..operators.assignment import greedy_in_order
from ..operators.site_pairs import Lists, coded, flat
from ..registry import query
from ..sources.catalog import CATALOG_SQL, catalog, priced, rnd, table
from ..sources.files import stored

_CARDS_SQL = f"""{CATALOG_SQL}, cards AS (SELECT site, product, name, category, vendor, price, string_split(name, ' ') AS ws FROM catalog)"""


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What matching needs of every site's products."""
    return catalog(spark, sf_dir).select("site", "product", "name", "category", "vendor", "price", F.split("name", " ").alias("ws"))


_SCORE_SQL = """floor((0.35 + least(0.3, 0.75 * coalesce(len(list_intersect(a.ws, b.ws)) / nullif(CAST(len(list_distinct(list_concat(a.ws, b.ws))) AS DOUBLE), 0), 0)) + 0.1 * CASE WHEN a.price > 0 AND b.price > 0 THEN greatest(0.0, 1.0 - abs(ln(a.price / b.price)) / ln(3.0)) ELSE 0.0 END + CASE WHEN a.vendor = b.vendor THEN 0.2 ELSE 0.0 END) * 10000 + 0.5) / 10000"""
_EDGES_SQL = f"""{_CARDS_SQL}, edges AS (SELECT b.site, a.product AS left_product, b.product AS right_product, {_SCORE_SQL} AS score FROM cards a JOIN cards b ON a.category = b.category WHERE a.site = 0 AND b.site <> 0)"""


def comparable(cards: DataFrame) -> DataFrame:
    """All pairs of an owner's and a rival's card of one category that score 0.45 or more.

    Pairs that share a word or the vendor are found among distinct classes (category, name, vendor)
    and joined back to products.  Any other pair has 0.35 and a tenth of its price closeness, so it
    reaches the bar, which rounding puts at 0.44995, only if the logarithms of its prices differ by
    0.0005 ln 3 or less; such prices lie in the same or neighbouring steps of 0.00055.
    """
    step = lambda c: F.floor(F.log(c) / 0.00055)
    side = lambda rows, p: rows.select("category", *(F.col(c).alias(f"{p}_{c}") for c in rows.columns if c != "category"))
    own, rival = side(cards.where("site = 0").drop("site"), "a"), side(cards.where("site <> 0"), "b")
    classes_a, classes_b = (x.select("category", f"{p}_name", f"{p}_vendor", f"{p}_ws").distinct() for x, p in ((own, "a"), (rival, "b")))

    worded = classes_a.withColumn("w", F.explode(F.array_distinct("a_ws"))).join(classes_b.withColumn("w", F.explode(F.array_distinct("b_ws"))), ["category", "w"]).drop("w")
    vended = classes_a.join(classes_b.withColumn("a_vendor", F.col("b_vendor")), ["category", "a_vendor"]).select(worded.columns)
    alike = worded.unionAll(vended).distinct().withColumn("names", F.least(F.lit(0.3), F.lit(0.75) * jaccard(F.col("a_ws"), F.col("b_ws"))))
    alike = alike.withColumn("vendors", F.when(F.col("a_vendor") == F.col("b_vendor"), 0.2).otherwise(0.0)).drop("a_ws", "b_ws")
    same = lambda p: [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("category", f"{p}_name", f"{p}_vendor")]
    alike = alike.alias("x").join(own.alias("y"), same("a")).select("x.*", "a_product", "a_price")
    alike = alike.alias("x").join(rival.alias("y"), same("b")).select("b_site", "a_product", "b_product", "a_price", "b_price", "names", "vendors")

    near = own.where("a_price > 0").withColumn("step", step("a_price")).withColumn("step", F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1)))
    near = near.join(rival.where("b_price > 0").withColumn("step", step("b_price")), ["category", "step"])
    near = near.where(~F.coalesce(F.col("a_vendor") == F.col("b_vendor"), F.lit(False)) & ~F.coalesce(F.arrays_overlap("a_ws", "b_ws"), F.lit(False)))
    near = near.select("b_site", "a_product", "b_product", "a_price", "b_price", F.lit(0.0).alias("names"), F.lit(0.0).alias("vendors"))

    score = rnd(F.lit(0.35) + F.col("names") + F.lit(0.1) * price_closeness(F.col("a_price"), F.col("b_price")) + F.col("vendors"), 4)
    return alike.unionAll(near).select(F.col("b_site").alias("site"), F.col("a_product").alias("left_product"), F.col("b_product").alias("right_product"), score.alias("score")).where("score >= 0.45")


@query(f"WITH {_EDGES_SQL} SELECT *, CASE WHEN score >= 0.62 THEN 'strong' ELSE 'moderate' END AS tier FROM edges WHERE score >= 0.45")
def product_match_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of the owner's and a rival's product that reach the bar, with their tier."""
    return comparable(_cards(spark, sf_dir)).withColumn("tier", F.when(F.col("score") >= 0.62, "strong").otherwise("moderate"))


_SIMILAR_SQL = """floor(least(1.0, len(list_intersect(a.ws, b.ws)) / CAST(len(list_distinct(list_concat(a.ws, b.ws))) AS DOUBLE) + CASE WHEN least(a.price, b.price) / nullif(greatest(a.price, b.price), 0) >= 0.6 THEN 0.15 * (least(a.price, b.price) / greatest(a.price, b.price)) ELSE 0.0 END) * 1000000 + 0.5) / 1000000"""


@query(f"""WITH {_CARDS_SQL}, e AS (SELECT b.site, a.product AS left_product, b.product AS right_product, {_SIMILAR_SQL} AS score FROM cards a JOIN cards b ON list_has_any(a.ws, b.ws) WHERE a.site = 0 AND b.site <> 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, left_product ORDER BY score DESC, right_product) AS n FROM e WHERE score >= 0.34) WHERE n = 1),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, right_product ORDER BY score DESC, left_product DESC) AS m FROM l) WHERE m = 1)
SELECT site, left_product, right_product, score FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, left_product DESC) AS k FROM r) WHERE k <= 40""")
def suggest_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best partner of each owner's product, then one owner's product per partner, forty per rival.

    A pair's score is the share of common words plus up to 0.15 for near prices.  Pairs are scored
    where a rival's products lie, so none is shuffled or written.
    """
    cards = priced(spark, sf_dir).select("site", "product", "name", "price").where("name is not null")
    return S.each_rival(cards.where("site <> 0"), cards.where("site = 0"), _suggested, "site long, left_product long, right_product long, score double")


def _suggested(owner: pa.Table, rows: pa.Table, most: int = 40, piece: int = S.PIECE) -> dict[str, np.ndarray]:
    """Suggestions for the owner's products out of a rival's; words are counted by names, of which there are fewer than products."""
    both = pa.concat_tables([owner, rows])
    names, texts = coded(both.column("name"))
    at, codes, _, _ = flat(pc.split_pattern(texts, " "))
    words = Lists(at, codes, len(texts))
    price, product = S.numbers(both, "price"), both.column("product").to_numpy()
    a, b = (x[np.argsort(product[x])] for x in (np.arange(len(owner)), np.arange(len(owner), len(both))))
    of_x, ix = np.unique(names[a], return_inverse=True)
    of_y, iy = np.unique(names[b], return_inverse=True)
    groups = np.split(a[np.argsort(ix, kind="stable")], np.cumsum(np.bincount(ix))[:-1]) if len(a) else []
    best: list[S.Edges] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    step = max(1, piece // max(1, len(of_y)))
    for k, group in enumerate(groups):
        if k % step == 0:
            shares = words.shares(of_x[k : k + step], of_y)
        # Products of the rival that share a word with this name.
        found = shares[k % step][iy]
        there = np.flatnonzero(found > 0)
        if not len(there):
            continue
        common, q = found[there], price[b[there]]
        for at in range(0, len(group), max(1, piece // len(there))):
            x = group[at : at + max(1, piece // len(there))]
            low, high = np.fmin(price[x][:, None], q), np.fmax(price[x][:, None], q)  # of a price that is not known the other is both, as in SQL
            ratio = np.divide(low, high, out=np.zeros_like(low), where=high != 0)
            score = S.rounded(np.minimum(1.0, common + np.where(ratio >= 0.6, 0.15 * ratio, 0.0)), 6)
            j = score.argmax(1)  # of equal scores the first product
            score = score[np.arange(len(x)), j]
            good = np.flatnonzero(score >= 0.34)
            best.append((product[x[good]], product[b[there[j[good]]]], score[good]))
    left, right, score = (np.concatenate(x) for x in zip(*best, strict=True))
    # One row for each of the owner's products, then one for each partner, then the best of all.
    order = np.lexsort((right, -score, left))
    order = order[np.unique(left[order], return_index=True)[1]]
    left, right, score = left[order], right[order], score[order]
    order = np.lexsort((-left, -score, right))
    order = order[np.unique(right[order], return_index=True)[1]]
    order = order[np.lexsort((-left[order], -score[order]))][:most]
    left, right, score = left[order], right[order], score[order]
    return {"left_product": left, "right_product": right, "score": score}


def _greedy(owner: pa.Table, rows: pa.Table) -> dict[str, object]:
    """Matches of the owner's products and a rival's, over all pairs of a category that comparable() has."""
    own, n = len(owner), len(owner) + len(rows)
    both = pa.concat_tables([owner, rows])
    (names, texts), (categories, _), (vendors, _) = (coded(both.column(c)) for c in ("name", "category", "vendor"))
    at, codes, _, _ = flat(pc.split_pattern(texts, " "))
    words = Lists(at, codes, len(texts) + 1)  # the last has no words, for products without name
    price, product = S.numbers(both, "price"), both.column("product").to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.where(price > 0, np.log(price), np.nan)
    names = np.where(names < 0, len(texts), names)

    def matches(a: np.ndarray, b: np.ndarray) -> S.Edges:
        a, b = (x[np.argsort(product[x], kind="stable")] for x in (a, b))

        def edges(xs: np.ndarray, ys: np.ndarray) -> S.Edges:
            x, y = a[xs], b[ys]
            (of_x, ix), (of_y, iy) = (np.unique(names[k], return_inverse=True) for k in (x, y))
            base = 0.35 + np.minimum(0.3, 0.75 * words.shares(of_x, of_y))[np.ix_(ix, iy)]
            same = (vendors[x][:, None] == vendors[y][None, :]) & (vendors[x] >= 0)[:, None]
            near = np.fmax(0.0, 1.0 - np.abs(log[x][:, None] - log[y][None, :]) / 1.0986122886681098)
            # Nearly the score; what may reach the bar is scored to the last bit.
            i, j = np.nonzero((base + 0.1 * near + 0.2 * same >= 0.4499) & (once or categories[x][:, None] == categories[y][None, :]))
            score = S.rounded(base[i, j] + 0.1 * S.closeness(price[x[i]], price[y[j]]) + np.where(same[i, j], 0.2, 0.0), 4)
            good = score >= 0.45
            return i[good], j[good], score[good]

        # A product that stands there twice is one end.
        left, right = (np.unique(product[k], return_inverse=True)[1] for k in (a, b))
        i, j, score = S.greedy(edges, left, right)
        return product[a[i]], product[b[j]], score

    once = all(len(np.unique(x)) == len(x) for x in (product[:own], product[own:]))
    wanted = np.intersect1d(categories[:own], categories[own:])
    wanted = wanted[wanted >= 0]
    # A product is of one category, so categories are matched by themselves, unless a product stands there twice.
    groups = [[c] for c in wanted] if once else [wanted]
    found = [matches(*(np.flatnonzero(np.isin(categories[lo:hi], g)) + lo for lo, hi in ((0, own), (own, n)))) for g in groups if len(g)]
    left, right, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return {"left_product": left, "right_product": right, "score": score}


@query()
def match_products_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy one-to-one matching per rival over all pairs of a category; tested against a plain greedy loop.

    Pairs are made and matched where a rival's products lie, so none is shuffled or written.
    """
    cards = priced(spark, sf_dir).select("site", "product", "name", "category", "vendor", "price")
    return S.each_rival(cards.where("site <> 0"), cards.where("site = 0"), _greedy, "site long, left_product long, right_product long, score double")


@query(f"""WITH {CATALOG_SQL}, g AS (SELECT site, category, vendor, count(*) AS n FROM catalog GROUP BY ALL), t AS (SELECT site, category, arg_max(vendor, (n, vendor)) AS vendor, max(n) AS n FROM g GROUP BY site, category),
u AS (SELECT * FROM t WHERE site = 0), c AS (SELECT category, arg_max(site, (n, site)) AS site, arg_max(vendor, (n, site)) AS vendor FROM t WHERE site <> 0 GROUP BY category)
SELECT coalesce(u.category, c.category) AS category, u.vendor AS user_collection, c.site AS rival, c.vendor AS rival_collection, CASE WHEN u.category IS NULL THEN 'competitor_only' WHEN c.category IS NULL THEN 'user_only' ELSE 'pair' END AS kind FROM u FULL JOIN c ON u.category = c.category""")
def auto_pair_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category each side's largest collection; pairs and what has no partner."""
    g = catalog(spark, sf_dir).groupBy("site", "category", "vendor").agg(F.count("*").alias("n"))
    top = g.groupBy("site", "category").agg(F.max(F.struct("n", "vendor")).alias("x")).select("site", "category", "x.vendor", "x.n")
    own = top.where("site = 0").select("category", F.col("vendor").alias("user_collection"))
    rival = top.where("site <> 0").groupBy("category").agg(F.max(F.struct("n", "site", "vendor")).alias("x")).select("category", F.col("x.site").alias("rival"), F.col("x.vendor").alias("rival_collection"))
    kind = F.when(F.col("user_collection").isNull(), "competitor_only").when(F.col("rival").isNull(), "user_only").otherwise("pair")
    return own.join(rival, "category", "full_outer").select("category", "user_collection", "rival", "rival_collection", kind.alias("kind"))


@query(f"""WITH {CATALOG_SQL}, m AS (SELECT s_suppkey AS site, s_nationkey % 6 AS c FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY site) - 1 AS ord FROM (SELECT DISTINCT site, category FROM catalog))
SELECT a.category, b.site, 1.0::DOUBLE AS confidence FROM (SELECT DISTINCT category FROM catalog WHERE site = 0) a JOIN (SELECT DISTINCT site, category FROM catalog WHERE site <> 0) b ON a.category = b.category JOIN m ON m.site = b.site
WHERE m.c = CASE a.category WHEN 'ECONOMY' THEN 0 WHEN 'LARGE' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'PROMO' THEN 3 WHEN 'SMALL' THEN 4 ELSE 5 END""")
def match_collections_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a mapping table names, at full confidence; similarity is not asked."""
    order = {"ECONOMY": 0, "LARGE": 1, "MEDIUM": 2, "PROMO": 3, "SMALL": 4, "STANDARD": 5}
    named = F.broadcast(spark.createDataFrame(list(order.items()), "category string, c int"))  # a fixed mapping
    collections = catalog(spark, sf_dir).select("site", "category").distinct()
    mapping = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_nationkey") % 6).alias("c")).join(named, "c").select("site", "category")
    own = collections.where("site = 0").select("category")
    return collections.where("site <> 0").join(mapping, ["site", "category"]).join(own, "category").select("category", "site", F.lit(1.0).alias("confidence"))


_COUNTS = "(SELECT k, name, g, count(*) AS n FROM (SELECT k, name, unnest(list_transform(generate_series(1, length(name) - 1), lambda i: substr(name, i, 2))) AS g FROM names) GROUP BY ALL)"


@query(f"""WITH names AS (SELECT DISTINCT 0 AS k, lower(p_name) AS name FROM part UNION ALL SELECT DISTINCT 1, lower(replace(p_brand, '#', '') || ' ' || split_part(p_name, ' ', 2)) FROM part),
c AS (SELECT a.name AS a, b.name AS b, sum(least(a.n, b.n)) AS shared FROM {_COUNTS} a JOIN {_COUNTS} b ON a.g = b.g WHERE a.k = 0 AND b.k = 1 GROUP BY ALL)
SELECT a, b, floor(2.0 * shared / (length(a) + length(b) - 2) * 10000 + 0.5) / 10000 AS dice FROM c""")
def url_dice_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice similarity of names by their pairs of letters, each as often as it occurs, for all names that share one."""
    part = table(spark, sf_dir, "part")
    mine = part.select(F.lower("p_name").alias("a")).distinct()
    theirs = part.select(F.lower(F.concat_ws(" ", F.replace("p_brand", F.lit("#"), F.lit("")), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("b")).distinct()
    grams = lambda rows, c: rows.select(c, F.explode(bigrams(F.col(c))).alias("g")).groupBy(c, "g").agg(F.count("*").alias(f"n{c}"))
    shared = grams(mine, "a").join(grams(theirs, "b"), "g").groupBy("a", "b").agg(F.sum(F.least("na", "nb")).alias("shared"))
    return shared.select("a", "b", rnd(2.0 * F.col("shared") / (F.length("a") + F.length("b") - 2), 4).alias("dice"))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which depends on the order of its arguments."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a.fillna(""), b.fillna(""), strict=True)])


@query()
def seq_ratio_text_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pages that follow each other on a host and how alike they are; equal ones need no Python."""
    from pyspark.sql import Window

    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), title.alias("new"))
    pages = pages.withColumn("old", F.lag("new").over(Window.partitionBy("host").orderBy("page_id"))).where("old is not null")
    return pages.select("page_id", F.when(F.col("old") == F.col("new"), 1.0).otherwise(sequence_ratio("old", "new")).alias("ratio")).withColumn("changed", F.col("ratio") < 0.75)


@query(f"""WITH {CATALOG_SQL}, s AS (SELECT site, count(*) AS n, CAST(sum(CAST(price AS DECIMAL(18,4))) AS DOUBLE) / count(*) AS p, count(DISTINCT vendor || '/' || name) AS v FROM catalog GROUP BY site), o AS (SELECT * FROM s WHERE site = 0)
SELECT site, floor((0.35 * least(s.p, o.p) / greatest(s.p, o.p) + 0.2 * least(s.n, o.n) / greatest(s.n, o.n) + 0.15 * least(s.v, o.v) / greatest(s.v, o.v)) / 0.7 * 10000 + 0.5) / 10000 AS similarity FROM (SELECT s.*, 1 AS j FROM s WHERE site <> 0) s JOIN (SELECT p, n, v, 1 AS j FROM o) o USING (j)""")
def competitor_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like the owner a competitor is: a mean of ratios, weights renormalised over those known."""
    s = catalog(spark, sf_dir).groupBy("site").agg(F.count("*").alias("n"), (F.sum(F.col("price").cast("decimal(18,4)")).cast("double") / F.count("*")).alias("p"), F.count_distinct(F.concat_ws("/", "vendor", "name")).alias("v"))
    own = F.broadcast(s.where("site = 0").select(*(F.col(c).alias(f"o{c}") for c in "npv")))  # one row
    near = lambda c: F.least(F.col(c), F.col(f"o{c}")) / F.greatest(F.col(c), F.col(f"o{c}"))
    return s.where("site <> 0").join(own).select("site", rnd((0.35 * near("p") + 0.2 * near("n") + 0.15 * near("v")) / 0.7, 4).alias("similarity"))


@query()
def match_collections_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matching of collections (a site's vendor within a category) by category, shared words and likeness of titles.

    Collections of different categories score below the bar of 0.35 whatever else they share, so
    candidates come from an equi-join on the category.  Titles are scored once per pair of
    vendors, not per site, and stored, so Spark knows how few they are and rivals meet them where
    they lie; a rival's category then has few edges, which one pass matches.  Tested against a plain greedy loop.
    """
    kept = catalog(spark, sf_dir).select("site", "category", "vendor").distinct().withColumn("number", F.regexp_extract("vendor", "([0-9]+)", 1).cast("int"))
    own = stored(kept.where("site = 0").select("category", F.col("vendor").alias("a"), F.col("number").alias("left_vendor")))
    rival = kept.where("site <> 0").select("category", "site", F.col("vendor").alias("b"), F.col("number").alias("right_vendor"))
    titles = own.join(rival.select("category", "b").distinct(), "category")
    words = lambda c: F.split(F.lower(F.concat_ws(" ", "category", c)), "[^a-z0-9]+")
    ratio = sequence_ratio(F.lower(F.concat_ws(" ", "category", "a")), F.lower(F.concat_ws(" ", "category", "b")))
    score = F.lit(0.6) + F.least(F.lit(0.25), F.lit(0.9) * jaccard(words("a"), words("b"))) + F.when(F.col("ratio") >= 0.5, F.least(F.lit(0.15), F.lit(0.15) * F.col("ratio"))).otherwise(0.0)
    scored = stored(titles.withColumn("ratio", ratio).select("category", "b", "left_vendor", rnd(score, 3).alias("score")))
    pairs = scored.join(rival, ["category", "b"]).select(F.concat_ws("/", "site", "category").alias("block"), "left_vendor", "right_vendor", "score")
    found = greedy_in_order(pairs, "block", "left_vendor", "right_vendor")
    parts = F.split("block", "/")
    return found.select(parts[0].cast("long").alias("site"), parts[1].alias("category"), "left_vendor", "right_vendor", F.col("score").alias("confidence"))


# Pages of the owner's host and of others.

# Words of paths that tell nothing, and what parts of a path tell its kind, in order.
PATH_STOP = ["collections", "collection", "products", "product", "category", "categories", "shop", "pages", "page", "en", "us", "index", "html", "the", "and", "for", "our", "all"]
PAGE_TYPES = {
    "pricing": ["pricing", "plans", "subscribe", "package"], "collection": ["collection", "categor", "shop", "catalog", "range"], "product": ["product", "/p/", "item", "sku"], "features": ["feature", "platform", "solution", "capabilit"],
    "services": ["service", "what-we-do", "offering"], "about": ["about", "company", "our-story", "who-we-are"], "blog": ["blog", "article", "news", "insight", "journal"], "contact": ["contact", "support", "help", "get-in-touch"],
    "case": ["case-stud", "customer", "success", "portfolio"],
}


def path_type(path: Column) -> Column:
    """The first kind that a path's parts name; home for the root."""
    rules = F.when(path.isin("/", ""), "home")
    for kind, names in PAGE_TYPES.items():
        rules = rules.when(F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(path, n)), kind)
    return rules.otherwise("other")


def _overlap(a: Column, b: Column) -> Column:
    """Dice similarity of two words by their pairs of letters, each as often as it occurs."""
    ga, gb = bigrams(a), bigrams(b)
    times = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))
    shared = F.aggregate(F.array_distinct(ga), F.lit(0), lambda n, g: n + F.least(times(ga, g), times(gb, g)))
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(2.0 * shared / (F.length(a) + F.length(b) - 2))


def _towards(a: Column, b: Column) -> Column:
    """How well the words of a are met by those of b, on average."""
    best = F.transform(a, lambda x: F.coalesce(F.array_max(F.transform(b, lambda y: _overlap(x, y))), F.lit(0.0)))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(best, F.lit(0.0), lambda n, x: n + x) / F.size(a)).otherwise(0.0)


def path_words(path: Column) -> Column:
    from ..functions.text import stem_slug

    words = F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda w: F.length(w) > 1)
    kept = F.filter(words, lambda w: ~w.isin(PATH_STOP))
    return F.transform(F.when(F.size(kept) > 0, kept).otherwise(words), stem_slug)


def matched_pages(pages: DataFrame, owner: str, bar: float = 0.5) -> DataFrame:
    """For each page (host, url) of another host the owner's best page at the bar or above: host, url, owner_url, score.

    Homepages go to the owner's homepage.  Paths are scored once each; a pair without a common pair
    of letters has at most 0.25 for its kind, so candidates come from a join on pairs of letters.
    """
    from ..functions.urls import pretty_path

    rows = pages.select("host", "url", F.lower(pretty_path(F.col("url"))).alias("path"))
    home = rows.where((F.col("host") == owner) & (F.col("path") == "/")).agg(F.min("url").alias("owner_url"))  # one row
    paths = rows.where("path <> '/'").select("path").distinct().withColumn("words", path_words(F.col("path"))).withColumns({"slug": F.array_join("words", ""), "kind": path_type(F.col("path"))})
    side = lambda p, who: rows.where(who & (F.col("path") != "/")).select("path").distinct().join(paths, "path").select(*(F.col(c).alias(f"{p}_{c}") for c in paths.columns)).withColumn("g", F.explode(F.array_distinct(F.flatten(F.transform(f"{p}_words", bigrams)))))
    pairs = side("a", F.col("host") == owner).join(side("b", F.col("host") != owner), "g").drop("g").distinct()
    leaf = lambda p: F.coalesce(F.get(f"{p}_words", F.size(f"{p}_words") - 1), F.lit(""))
    a, b = F.col("a_words"), F.col("b_words")
    score = 0.4 * (_towards(a, b) + _towards(b, a)) / 2 + 0.15 * _overlap(F.col("a_slug"), F.col("b_slug")) + 0.2 * _overlap(leaf("a"), leaf("b")) + F.when((F.col("a_kind") == F.col("b_kind")) & (F.col("a_kind") != "other"), 0.25).otherwise(0.0)
    first = rows.where(F.col("host") == owner).groupBy(F.col("path").alias("a_path")).agg(F.min("url").alias("owner_url"))
    scored = pairs.select("a_path", "b_path", rnd(score, 6).alias("score")).where(F.col("score") >= bar).join(first, "a_path")
    best = scored.groupBy("b_path").agg(F.min(F.struct((-F.col("score")).alias("s"), "owner_url")).alias("x"))
    found = rows.where(F.col("host") != owner).join(best, F.col("path") == F.col("b_path")).select("host", "url", F.col("x.owner_url").alias("owner_url"), (-F.col("x.s")).alias("score"))
    homes = rows.where((F.col("host") != owner) & (F.col("path") == "/")).join(F.broadcast(home)).where("owner_url is not null").select("host", "url", "owner_url", F.lit(1.0).alias("score"))
    return found.unionByName(homes)


def _site_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """Pages with a shop's paths made of the parts: host (the brand), url; and the owner's host."""
    kind = F.element_at(F.array(*map(F.lit, ["products/", "collections/", "blog/", "about-", ""])), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.when(F.col("p_partkey") % 17 == 0, "").otherwise(F.concat(kind, F.replace("p_name", F.lit(" "), F.lit("-")), F.when(F.col("p_partkey") % 3 == 0, "s").otherwise("")))
    rows = table(spark, sf_dir, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("host"), path.alias("path")).distinct()
    return rows.select("host", F.concat(F.lit("https://"), "host", F.lit(".example/"), "path").alias("url")), "brand-11"


@query()
def url_page_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rival page and the owner's page that its url matches; tested against a plain loop."""
    return matched_pages(*_site_pages(spark, sf_dir))


@query()
def unmapped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rival pages that no page of the owner matches, and how many pages of the owner each rival leaves without a partner."""
    pages, owner = _site_pages(spark, sf_dir)
    found = matched_pages(pages, owner)
    mine = pages.where(F.col("host") == owner).agg(F.count("*").alias("mine"))  # one row
    taken = found.groupBy("host").agg(F.count_distinct("owner_url").alias("taken"))
    rest = pages.where(F.col("host") != owner).join(found.select("url"), "url", "left_anti").groupBy("host").agg(F.count("*").alias("unmapped"))
    return pages.where(F.col("host") != owner).select("host").distinct().join(rest, "host", "left").join(taken, "host", "left").join(F.broadcast(mine)).select("host", F.coalesce("unmapped", F.lit(0)).alias("unmapped"), (F.col("mine") - F.coalesce("taken", F.lit(0))).alias("owner_gap"))


@query()
def page_match_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner's pages in their order, each with the best page of a rival that is still free, by kind, words of the url and likeness of titles; tested against a plain loop.

    Pairs below 0.35 never match.  A pair of another kind has at most 0.3 for words and title, so candidates come from a join on the kind.
    """
    from ..operators.assignment import first_come

    pages, owner = _site_pages(spark, sf_dir)
    path = F.lower(F.regexp_extract("url", "//[^/]+(/.*)$", 1))
    rows = pages.select("host", "url", path.alias("path")).withColumns({"kind": path_type(F.col("path")), "words": F.array_distinct(path_words(F.col("path")))})
    mine = rows.where(F.col("host") == owner).select(F.col("url").alias("a"), "kind", F.col("words").alias("wa"), F.col("path").alias("pa"))
    theirs = rows.where(F.col("host") != owner).select("host", F.col("url").alias("b"), "kind", F.col("words").alias("wb"), F.col("path").alias("pb"))
    ratios = mine.select("kind", "pa").distinct().join(theirs.select("kind", "pb").distinct(), "kind").select("pa", "pb", sequence_ratio("pa", "pb").alias("ratio"))
    edges_ = mine.join(theirs, "kind").join(ratios, ["pa", "pb"])
    score = F.lit(0.45) + F.least(F.lit(0.2), F.lit(0.5) * jaccard(F.col("wa"), F.col("wb"))) + F.when(F.col("ratio") >= 0.35, F.least(F.lit(0.1), F.lit(0.1) * F.col("ratio"))).otherwise(0.0)
    return first_come(edges_.select("host", "a", "b", rnd(score, 3).alias("score")), "host", "a", "b")
