"""Matchings against plain loops."""

import os
from difflib import SequenceMatcher

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

STOP = {"collections", "collection", "products", "product", "category", "categories", "shop", "pages", "page", "en", "us", "index", "html", "the", "and", "for", "our", "all"}


def stem(w):
    if len(w) <= 3:
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if w.endswith(("ches", "shes", "sses", "xes", "zes")):
        return w[:-2]
    if w.endswith("es") and len(w) > 4:
        return w[:-1]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def words(path):
    import re

    found = [w for w in re.split("[^a-z0-9]+", path) if len(w) > 1]
    return [stem(w) for w in ([w for w in found if w not in STOP] or found)]


def dice(a, b):
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    rest, shared = [b[k : k + 2] for k in range(len(b) - 1)], 0
    for k in range(len(a) - 1):
        if a[k : k + 2] in rest:
            rest.remove(a[k : k + 2])
            shared += 1
    return 2 * shared / (len(a) + len(b) - 2)


def kind(path):
    from shelfscope.plans.matching import PAGE_TYPES

    return "home" if path in ("", "/") else next((k for k, parts in PAGE_TYPES.items() if any(p in path for p in parts)), "other")


def score(pa, pb):
    a, b = words(pa), words(pb)
    towards = lambda x, y: sum(max(dice(w, v) for v in y) for w in x) / len(x) if x and y else 0
    total = 0.4 * (towards(a, b) + towards(b, a)) / 2 + 0.15 * dice("".join(a), "".join(b)) + 0.2 * dice(a[-1] if a else "", b[-1] if b else "")
    return total + 0.25 * (kind(pa) == kind(pb) != "other")


def path_of(url):
    path = "/" + url.split("//", 1)[1].split("/", 1)[1]
    return path if path == "/" else path.rstrip("/")


def test_pages_by_url(spark):
    from shelfscope.plans.matching import _site_pages, matched_pages

    pages, owner = _site_pages(spark, DATA)
    rows = [(r["host"], r["url"]) for r in pages.collect()]
    got = {r["url"]: (r["owner_url"], round(r["score"], 5)) for r in matched_pages(pages, owner).collect()}
    mine = sorted(u for h, u in rows if h == owner)
    want = {}
    for h, u in rows:
        if h == owner:
            continue
        if path_of(u) == "/":
            home = [m for m in mine if path_of(m) == "/"]
            if home:
                want[u] = (home[0], 1.0)
            continue
        found = [(-round(score(path_of(m), path_of(u)), 6), m) for m in mine if path_of(m) != "/"]
        best = min(found, default=(0, ""))
        if -best[0] >= 0.5:
            want[u] = (best[1], round(-best[0], 5))
    assert want
    assert got == want


def test_pages_in_order(spark):
    from shelfscope.plans.matching import _site_pages, page_match_sequential

    pages, owner = _site_pages(spark, DATA)
    rows = [(r["host"], r["url"]) for r in pages.collect()]
    want = set()
    for host in {h for h, _ in rows if h != owner}:
        used = set()
        for a in sorted(u for h, u in rows if h == owner):
            best = None
            for b in sorted(u for h, u in rows if h == host and u not in used):
                pa, pb = "/" + a.split("//", 1)[1].split("/", 1)[1], "/" + b.split("//", 1)[1].split("/", 1)[1]
                if kind(pa) != kind(pb):
                    continue
                wa, wb = set(words(pa)), set(words(pb))
                ratio = SequenceMatcher(None, pa, pb).ratio()
                s = 0.45 + (min(0.2, 0.5 * len(wa & wb) / len(wa | wb)) if wa | wb else 0) + (min(0.1, 0.1 * ratio) if ratio >= 0.35 else 0)
                s = int(s * 1000 + 0.5) / 1000
                if best is None or s > best[0]:
                    best = (s, b)
            if best:
                used.add(best[1])
                want.add((host, a, best[1]))
    got = {(r["host"], r["a"], r["b"]) for r in page_match_sequential(spark, DATA).collect()}
    assert got == want


def test_state_of_a_key_without_value(spark, tmp_path):
    from shelfscope.streaming.jobs import snapshot_diffs

    rows = [(k, 1, f"2024-01-01 00:00:0{k}", '{"k": 3}' if k % 2 else "{}") for k in range(4)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts string, props string").selectExpr("event_id", "user_id", "to_timestamp_ntz(ts) AS ts", "props", "'x' AS event_type", "1.0D AS value")
    df.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["event_id"], r["k"], r["delta"]) for r in snapshot_diffs(spark, str(tmp_path)).collect())
    assert got == [(0, None, None), (1, 3, None), (2, None, None), (3, 3, None)]


def test_a_cluster_needs_a_shared_folder():
    from shelfscope.sources.files import shared_folder

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_folder(Session(), "x")


def test_collections_meet_their_scores_where_they_lie(spark):
    from shelfscope import registry

    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        plan = registry.queries()["match_collections_greedy"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # One pass over the edges; they are not checkpointed round by round, and no join is by category alone.
    assert "MapInArrow" in plan and "hashpartitioning(category" not in plan
