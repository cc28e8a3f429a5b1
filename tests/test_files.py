"""Tables that are changed by a log of files, and documents in files."""

import pytest
from pyspark.sql import functions as F

from shelfscope.sources.files import Conflict, Table, read_documents


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k long, v string, n long")


def held(table, version=None):
    return sorted(tuple(r) for r in table.read(version).collect())


def size(table, files):
    total = 0
    for f in files:
        jpath, fs = table._fs(f"{table.path}/data/{f}")
        total += fs.getFileStatus(jpath).getLen()
    return total


def test_changes_and_versions(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", most_rows=10)
    t.create(rows(spark, [(k, "a", 0) for k in range(100)]).repartition(4))
    t.append(rows(spark, [(200, "b", 0), (None, "null key", 0)]))
    t.upsert(rows(spark, [(5, "old", 1), (5, "new", 2), (300, "c", 1)]), ["k"], "n")
    want = sorted([*((k, "a", 0) for k in range(100) if k != 5), (200, "b", 0), (5, "new", 2), (300, "c", 1)])
    assert sorted(map(tuple, t.read().where("k is not null").collect())) == want
    t.upsert(rows(spark, [(5, "old", 1), (5, "new", 2), (300, "c", 1)]), ["k"], "n")
    assert sorted(map(tuple, t.read().where("k is not null").collect())) == want
    t.delete(spark.createDataFrame([(0,), (1,), (999,)], "k long"))
    t.update(F.col("v") == "b", v=F.concat("v", F.lit("!")), n=F.lit(7))
    assert sorted(map(tuple, t.read().where("k is not null").collect())) == sorted([r if r[0] != 200 else (200, "b!", 7) for r in want if r[0] not in (0, 1)])
    assert t.version == 6 and t.read(1).count() == 100 and t.read(2).count() == 102
    other = Table(spark, t.path)
    assert other.read().count() == t.read().count()  # the log is on disk, not in the object
    for k in range(12):
        t.append(rows(spark, [(1000 + k, "x", 0)]))
    assert t.version == 18 and t.read().count() == 101 + 12
    before = t.files()[0]
    assert Table(spark, t.path).vacuum().read().count() == 113 and t.files()[0] == before
    t.create(rows(spark, []))
    assert t.read().count() == 0 and t.append(rows(spark, [(1, "y", 1)])).read().count() == 1


def test_what_a_row_writes_does_not_grow_with_the_table(spark, tmp_path):
    written = []
    for n in (4_000, 60_000):
        t = Table(spark, f"file://{tmp_path}/t{n}", most_rows=500).create(spark.range(n).coalesce(2).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.lit(0).cast("long").alias("n")))
        old = set(t.files()[0])
        t.upsert(rows(spark, [(7, "new", 1)]), ["k"], "n")
        new = set(t.files()[0]) - old
        assert len(old - set(t.files()[0])) == 1 and t.read().count() == n
        written.append(size(t, new))
        old = set(t.files()[0])
        t.append(rows(spark, [(-1, "more", 1)]))
        assert old <= set(t.files()[0])
    assert written[1] < 1.3 * written[0]


def test_two_writers(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t", most_rows=10).create(rows(spark, [(k, "a", 0) for k in range(40)]).coalesce(1))
    seen = t.version
    first, second = Table(spark, t.path), Table(spark, t.path)
    names, old = second._touched(seen, keys=spark.createDataFrame([(3,)], "k long"))
    first.upsert(rows(spark, [(3, "first", 1)]), ["k"], "n")
    with pytest.raises(Conflict):  # the same file was replaced in the meantime
        second._commit(seen, second._written(old), names, old.schema.json())
    assert held(t, t.version)[3] == (3, "first", 1)
    names, old = second._touched(t.version, keys=spark.createDataFrame([(35,)], "k long"))
    at = t.version
    first.append(rows(spark, [(100, "append", 0)]))
    second._commit(at, second._written(old.where("k <> 35")), names, old.schema.json())  # other files: goes second
    assert t.read().count() == 40 and t.read().where("k = 35").isEmpty()


def test_documents(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = read_documents(spark, f"{tmp_path}/lines", "a int")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["text"] for r in bad.collect()] == ["not json"]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.json").write_text('{\n  "a":\n 1\n}')
    (tmp_path / "whole" / "b.json").write_text('[{"a": 2},\n {"a": 3}]')
    (tmp_path / "whole" / "c.json").write_text("{broken")
    good, bad = read_documents(spark, f"{tmp_path}/whole", "a int", whole=True)
    assert sorted(r["a"] for r in good.collect()) == [1, 2, 3] and [r["text"] for r in bad.collect()] == ["{broken"]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "a.json").write_text("x\ny\n")
    with pytest.raises(ValueError):
        read_documents(spark, f"{tmp_path}/none", "a int")
