"""JSON walks and report differences against plain recursion."""

import json
import random

from shelfscope.operators.json_tree import report_changes, walk


def plain(value, path="", level=0, identity=(), depth=12):
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"
    yield path, kind, value if kind == "string" else None if kind in ("null", "array", "object") else json.dumps(value)
    if level < depth:
        if isinstance(value, dict):
            for k, v in value.items():
                yield from plain(v, f"{path}/{k}", level + 1, identity, depth)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                name = next((str(v[n]) for n in identity if v.get(n) is not None), i) if isinstance(v, dict) else i
                yield from plain(v, f"{path}/[{name}]", level + 1, identity, depth)


def grown(rnd, depth=0):
    kind = rnd.choice(["obj", "list", "str", "int", "bool", "null"]) if depth < 5 else "str"
    if kind == "obj":
        return {rnd.choice("abcdé") + str(i): grown(rnd, depth + 1) for i in range(rnd.randint(0, 3))} | ({"id": f"i{rnd.randint(0, 99)}"} if rnd.random() < 0.3 else {})
    if kind == "list":
        return [grown(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return {"str": rnd.choice(["", "x y", "5", "ü\n"]), "int": rnd.randint(-5, 5), "bool": rnd.random() < 0.5, "null": None}[kind]


def test_walks_equal_a_recursion(spark):
    rnd = random.Random(2)
    values = [grown(rnd) for _ in range(150)]
    deep = leaf = []
    for _ in range(20):
        leaf.append([])
        leaf = leaf[0]
    rows = [(k, json.dumps(v)) for k, v in enumerate([*values, deep])] + [(900, "no json"), (901, None), (902, "")]
    for identity in ((), ("id",)):
        got = sorted((r["k"], r["path"], r["kind"], r["value"]) for r in walk(spark.createDataFrame(rows, "k long, j string").repartition(4), ["k"], "j", identity).collect())
        want = [(k, *n) for k, v in enumerate([*values, deep]) for n in plain(v, identity=identity)]
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_changes_of_reports(spark):
    old = {"a": 1, "b": {"c": "Some  Text"}, "l": [{"id": "x", "p": 1}, {"id": "y", "p": 2}], "gone": None, "n": "2.0"}
    new = {"a": 1.0, "b": {"c": "some text"}, "l": [{"id": "y", "p": 3}, {"id": "x", "p": 1}, {"id": "z"}], "n": 2, "more": True}
    frame = lambda v: spark.createDataFrame([(1, json.dumps(v)), (2, "{}")], "k long, j string")
    got = {(r["k"], r["path"]): (r["change"], r["old"], r["new"]) for r in report_changes(frame(old), frame(new), ["k"], "j", ("id",)).collect()}
    assert got == {(1, "/l/[y]/p"): ("changed", "2", "3"), (1, "/l/[z]/id"): ("added", None, "z"), (1, "/gone"): ("removed", None, None), (1, "/more"): ("added", None, "true")}
    assert report_changes(frame(old).limit(0), frame(new).limit(0), ["k"], "j", ()).count() == 0


def test_reports_are_built_and_walked_once(spark):
    from shelfscope import registry

    plan = registry.queries()["yearly_report_changes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    # One scan of each table; changes are found where the pair of reports lies.
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 3


def test_diffs_of_reports_shuffle_reports_by_key_only(spark):
    from shelfscope import registry

    plan = registry.queries()["comparison_diffs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "SortMergeJoin" not in plan


def test_diffs_of_reports_make_no_texts(spark):
    from shelfscope import registry

    plan = registry.queries()["comparison_diffs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().lower()
    # Four fields are compared in columns; no report is written as JSON, parsed and walked.
    assert "to_json" not in plan and "parse_json" not in plan and "collect_list" not in plan


def test_yearly_changes_of_odd_reports(spark, tmp_path):
    """Years that are missing, states that are null, names that are numbers, against plain dictionaries of leaves."""
    from pyspark.sql import functions as F

    from shelfscope import registry

    rnd = random.Random(6)
    names = [None, "rod", " 17 ", "1e3", "Nancy", ".5x", "inf"]
    parts = [(p, names[p % 7], "x" if p % 3 else None if p % 2 else "y", 1, 1.0, "B") for p in range(40)]
    lines = [(s, p, k, 1 + k % 3, rnd.choice([None, 10.0, 20.0, 20.0]), 2.0, 0.0, rnd.choice(["R", "N", None]), rnd.choice(["O", "F"]), f"{rnd.choice([1992, 1993, 1995, 1996])}-02-0{1 + k % 9}") for k, (s, p) in enumerate((s, p) for s in range(3) for p in range(40) for _ in range(2))]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_orderkey long, l_linenumber int, l_extendedprice double, l_quantity double, l_discount double, l_returnflag string, l_linestatus string, l_shipdate string").withColumn("l_shipdate", F.to_timestamp("l_shipdate")).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double, p_brand string").write.parquet(f"{tmp_path}/part.parquet")

    newest, want = {}, set()
    for x in lines:
        key = (x[0], x[1], int(x[9][:4]))
        newest[key] = max(newest.get(key, ("",)), (x[9], x[2], x))
    reports = {}
    for (site, product, year), (_, _, x) in newest.items():
        category = parts[product][2]
        if category is not None:
            stock = None if x[7] in ("R", None) else "in stock" if x[8] == "O" else "sold out"
            leaves = {"id": str(product), "name": parts[product][1], "price/amount": None if x[4] is None else x[4] / 2, "price/currency": "USD", "stock": stock, "rank": x[3]}
            report = reports.setdefault((site, category, year), {"/summary/count": 0})
            report["/summary/count"] += 1
            report.update({f"/products/[{product}]/{k}": v for k, v in leaves.items() if v is not None})

    def both(v):
        try:
            return (None, None) if v is None else (float(v), None)
        except ValueError:
            return None, v

    for (site, category, year), new in reports.items():
        old = reports.get((site, category, year - 1))
        for path in {*new, *old} if old is not None else ():
            a, b = old.get(path), new.get(path)
            if a != b:
                (an, at), (bn, bt) = both(a), both(b)
                want.add((site, category, year, path, "added" if a is None else "removed" if b is None else "changed", an, bn, at, bt))
    query = registry.queries()["yearly_report_changes"](spark, str(tmp_path))
    assert len(want) > 200 and sorted(map(str, {tuple(r) for r in query.collect()})) == sorted(map(str, want))
    # Leaves are compared in columns; no report is written as JSON, parsed and walked.
    plan = query._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "to_json" not in plan and "parse_json" not in plan and "collect_list" not in plan
