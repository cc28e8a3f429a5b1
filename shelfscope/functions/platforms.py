"""Which platform a site runs on: markers in html, url and headers, counted, weighed and decided.

``found`` lists what markers stand where, as field:marker.  Scores are columns that steps change in
order; steps are SQL that both engines read.
"""

from __future__ import annotations

from .page_type import Dialect

# Markers that only the platform itself leaves, by platform; on ties the later one of the list goes first.
DEFINITIVE = {
    "Wix": ["static.wixstatic.com", "static.parastorage.com", "wixstatic.com", "parastorage.com", "wix-thunderbolt", "wix-warmup-data", "wixsite.com", "wixstores", "_wixcssstates", "x-wix"],
    "Shopify": ["cdn.shopify.com", "shopifycdn.com", "/cdn/shop/", "myshopify.com", "monorail-edge.shopifysvc", "x-shopify", "x-shopid", "x-shopify-stage", "x-sorting-hat-shopid"],
    "WordPress": ["/wp-content/", "wp-content/themes", "wp-content/uploads", "wp-content/plugins", "/wp-includes/", "/wp-json/", "wp-emoji", "wp-block-", "wp-embed.min.js", "wp-content/plugins/woocommerce", "wc-cart-fragments", "wc-ajax", "woocommerce-page", "woocommerce-store-api"],
}
# Markers that count one point each; the order decides ties.
HEURISTIC = {
    "Shopify": ["cdn.shopify.com", "shopify.theme", "shopify.routes", "window.shopify", "shopify.shop", "shopify-checkout-api-token", "myshopify.com", "shopify-section", "/cart.js", "/cart/add", "shopify-payment-button", "shopify-buy", "shopify-features", "shopifyanalytics", "shopify_pay", "shopify-analytics", "shopify_analytics", "shopify_marketing", "shopify_essential", "shopify.designmode", "shopify.country", "powered-by\":\"shopify", "powered-by=shopify"],
    "WooCommerce / WordPress": ["woocommerce", "wc-cart-fragments", "wp-content/plugins/woocommerce", "woocommerce-page", "woocommerce-product", "woocommerce-cart", "woocommerce-checkout", "add_to_cart_button", "single_add_to_cart_button", "wc-ajax", "?add-to-cart="],
    "WordPress": ["wp-content/", "wp-includes/", "/wp-json/", "wp-emoji-release", "wordpress.org", "wp-block-"],
    "Wix": ["static.wixstatic.com", "static.parastorage.com", "wix-code", "wixsite.com", "wixstores", "x-wix", "wix-thunderbolt", "wix-window", "wix-bi"],
    "Webflow": ["webflow.js", "webflow.io", "uploads-ssl.webflow.com", "w-webflow-badge"],
    "Magento": ["magento", "mage/cookies", "static/frontend", "mageplaza", "mage-cache", "mage-cache-storage", "customer-data.js", "catalog/product/view", "checkout/cart"],
    "Next.js / React": ["__next_data__", "/_next/static", "next-head-count", "_next/image", "__next_f", "next-router"],
    "React": ["data-reactroot", "react-dom", "reactroot", "__react", "react.development.js", "react.production.min.js"],
    "Vue": ["vue.js", "__vue__", "data-v-", "vue-router", "vuex"],
    "HubSpot CMS": ["hs_cos_wrapper", "hubspot-wrapper", "hs-menu-wrapper", "hubspotusercontent"],
    "Squarespace": ["squarespace.com", "static1.squarespace.com", "sqs-block", "squarespace-cdn.com", "sqs-layout"],
    "BigCommerce": ["bigcommerce.com", "cdn11.bigcommerce.com", "stencil-utils", "bigcommerce.stencil"],
}
# Embedded forms, markers of boosts, and names to show.
EMBEDS = ["hs-scripts.com", "hs-analytics.net", "hs-banner.com", "hsforms.net", "hsforms.com"]
BOOSTS = ["powered-by", "shopify", "server-timing", "pagetype;desc=", "page_cache:", "collectiondetailscontroller", "productdetailscontroller", "indexcontroller", "x-request-id", "x-powered-by", "next.js", "x-magento", "section-main-product.css", "section-main-collection.css", "/products/", "/collections/", "/blogs/", "/product/", "/product-category/"]
SHOWN = {"Magento": "Magento", "Webflow": "Webflow", "Squarespace": "Squarespace", "BigCommerce": "BigCommerce", "Next.js / React": "React / Next.js", "React": "React", "Vue": "Vue.js", "HubSpot CMS": "HubSpot CMS"}
UNDETECTED = "Custom / Undetected"
COLUMNS = {name: "s_" + "".join(c for c in name.lower() if c.isalpha()) for name in HEURISTIC}


def markers() -> list[str]:
    return sorted({m for lists in (DEFINITIVE, HEURISTIC) for found in lists.values() for m in found} | set(EMBEDS) | set(BOOSTS))


def steps(d: Dialect) -> list[dict[str, str]]:
    """Columns to compute from found, in order; the last have platform, display, confidence, known and headless."""
    at = lambda field, *names: "(" + " OR ".join(d.holds("found", f"{field}:{n}") for n in names) + ")"
    anywhere = lambda *names: "(" + " OR ".join(at(f, *names) for f in ("html", "url", "headers")) + ")"
    count = lambda names: "(" + " + ".join(f"CAST({anywhere(n)} AS INT)" for n in names) + ")"
    c = COLUMNS
    shop, woo, wp, wix, flow, mage, next_, react, vue, hub, _, big = c.values()
    less = lambda col, by, test: {col: f"CASE WHEN {test} THEN greatest(0, {col} - {by}) ELSE {col} END"}
    more = lambda col, *pairs: {col: f"{col} + " + " + ".join(f"CASE WHEN {test} THEN {n} ELSE 0 END" for n, test in pairs)}
    table: list[dict[str, str]] = [
        {f"t1_{k.lower()}": count(v) for k, v in DEFINITIVE.items()} | {c[k]: count(v) for k, v in HEURISTIC.items()},
        # Boosts.
        more(hub, (1, f"{at('html', *EMBEDS)} OR {at('headers', *EMBEDS)}"))
        | more(shop, (6, f"{at('headers', 'powered-by')} AND {at('headers', 'shopify')}"), (5, f"{at('headers', 'server-timing')} AND {at('headers', 'pagetype;desc=')}"), (6, f"{at('headers', 'page_cache:')} AND {at('headers', 'collectiondetailscontroller', 'productdetailscontroller', 'indexcontroller')}"), (3, f"{at('headers', 'x-request-id')} AND {at('headers', 'shopify')}"), (4, f"{at('html', 'section-main-product.css')} OR {at('headers', 'section-main-product.css')}"), (4, f"{at('html', 'section-main-collection.css')} OR {at('headers', 'section-main-collection.css')}"), (3, at("url", "/products/")), (3, at("url", "/collections/")), (2, at("url", "/blogs/")))
        | more(next_, (5, f"{at('headers', 'x-powered-by')} AND {at('headers', 'next.js')}")) | more(mage, (5, at("headers", "x-magento"))) | more(wp, (4, at("html", "wp-content/"))) | more(flow, (5, at("url", "webflow.io"))),
        less(shop, 3, at("html", "wp-content/")) | less(wix, 3, at("html", "wp-content/")) | more(woo, (2, f"{at('url', '/product/', '/product-category/')} AND ({woo} > 0 OR {wp} > 0)")),
        # Conflicts, each after the one before.
        less(wp, 3, f"{woo} >= 2") | less(react, 3, f"{wix} >= 2") | less(next_, 1, f"{wix} >= 2"),
        less(react, 3, f"{next_} >= 2"),
        {"headless": f"{shop} >= 3 AND {next_} >= 2"} | less(next_, 3, f"{shop} >= 3 AND {next_} >= 2"),
        {"headless": f"headless OR ({shop} >= 3 AND {react} >= 2)"} | less(react, 3, f"{shop} >= 3 AND {react} >= 2"),
        {"strong_one": f"greatest({shop}, {woo}, {wp}, {wix}, {mage}) >= 2"},
        less(react, 3, "strong_one") | less(vue, 3, "strong_one") | {flow: f"CASE WHEN NOT ({anywhere('webflow.io')} OR {at('html', 'webflow.js', 'w-webflow-badge', 'uploads-ssl.webflow.com')}) OR ({flow} < 3 AND NOT {at('url', 'webflow.io')}) THEN 0 ELSE {flow} END"},
        {"front": f"greatest({next_}, {react})"},
        {"headless": f"headless OR (({shop} >= 2 OR {big} >= 2) AND front >= 2)", shop: f"CASE WHEN {shop} >= 2 AND front >= 2 THEN {shop} + front ELSE {shop} END", big: f"CASE WHEN {shop} < 2 AND {big} >= 2 AND front >= 2 THEN {big} + front ELSE {big} END"},
        {"best": f"greatest({', '.join(c.values())})"},
        {"winner": "CASE " + " ".join(f"WHEN {col} = best THEN '{name}'" for name, col in c.items()) + " END", "top_shown": f"greatest({', '.join(c[n] for n in SHOWN)})"},
        {"nameable": "CASE WHEN top_shown < 2 THEN '" + UNDETECTED + "' " + " ".join(f"WHEN {c[n]} = top_shown THEN '{label}'" for n, label in SHOWN.items()) + " END"},
        {"verdict": "CASE WHEN greatest(t1_wix, t1_shopify, t1_wordpress) > 0 THEN 'definitive' WHEN best <= 2 AND winner IN ('Webflow', 'React', 'Vue', 'HubSpot CMS', 'Squarespace', 'BigCommerce') THEN 'weak' WHEN winner IN ('Shopify', 'WordPress', 'WooCommerce / WordPress', 'Wix') THEN 'downgraded' ELSE 'heuristic' END", "sure": "CASE WHEN t1_wordpress >= greatest(t1_shopify, t1_wix) THEN 'WordPress' WHEN t1_shopify >= t1_wix THEN 'Shopify' ELSE 'Wix' END"},
        {
            "platform": "CASE verdict WHEN 'definitive' THEN sure WHEN 'heuristic' THEN CASE WHEN best <= 0 THEN 'Unknown' ELSE winner END ELSE 'Unknown' END",
            "display": "CASE verdict WHEN 'definitive' THEN sure ELSE nameable END",
            "confidence": "CASE verdict WHEN 'definitive' THEN 0.98 WHEN 'weak' THEN 0.25 WHEN 'downgraded' THEN 0.3 ELSE CASE WHEN best <= 0 THEN 0.2 WHEN best = 1 THEN 0.45 WHEN best = 2 THEN 0.65 WHEN best = 3 THEN 0.78 ELSE least(0.95, 0.78 + (best - 3) * 0.04) END END",
            "headless": f"CASE verdict WHEN 'definitive' THEN sure = 'Shopify' AND {at('html', '__next_data__', '/_next/static', 'data-reactroot', 'react-dom')} WHEN 'downgraded' THEN FALSE ELSE headless END",
        },
    ]
    return table
