"""Keyed tables in hash buckets: what a feed touches, one switch, refused writers; answers read by year."""

import datetime as dt
import functools
import pathlib

import pytest
from pyspark.sql import functions as F

from terrascope import sinks

CITY = ("insee_code STRING, name STRING, postal_code STRING, department_code STRING, population BIGINT, area DOUBLE, "
        "latitude DOUBLE, longitude DOUBLE")


def cities(spark, codes, name="old", department="01"):
    return spark.createDataFrame([(c, f"{name} {c}", "1", department, 5, 1.0, None, None) for c in codes], CITY)


@pytest.fixture
def table(spark, tmp_path):
    table = sinks.BucketTable(spark, str(tmp_path / "cities"))
    codes = [f"{i:05d}" for i in range(2000)]
    assert table.create(cities(spark, codes), ["insee_code"], buckets=64) == 2000
    return table


def files(table):
    return {p for p in pathlib.Path(table.root).rglob("*.parquet")}


def names(table):
    return {r["insee_code"]: (r["name"], r["department_code"]) for r in table.read().collect()}


def test_ten_rows_touch_ten_buckets_at_most(spark, table):
    before, old = files(table), names(table)
    feed = cities(spark, [f"{i * 150:05d}" for i in range(9)] + ["new"], "new", "99")
    done = table.merge(feed, sinks.upsert_cities)
    assert 1 <= done["touched"] <= 10
    written = {p.parent.name for p in files(table) - before}
    assert len(written) == done["touched"] and before <= files(table)
    want = {**old, **{f"{i * 150:05d}": (f"new {i * 150:05d}", "01") for i in range(9)}, "new": ("new new", "99")}
    assert names(table) == want
    # only the touched buckets were read
    read = set(table.read().inputFiles())
    assert len({f for f in read if any(str(p) in f for p in before)}) < len(before)
    assert table.prune() == done["touched"]
    assert names(table) == want and len(files(table)) == len(before)


def test_a_merge_equals_the_merge_of_whole_tables(spark, tmp_path):
    old = cities(spark, [str(i) for i in range(300)]).unionByName(cities(spark, [None]))
    feeds = [cities(spark, [str(i) for i in range(f * 90, f * 90 + 150)], f"feed {f}") for f in range(3)]
    table = sinks.BucketTable(spark, str(tmp_path / "t"))
    table.create(old, ["insee_code"], buckets=7)
    whole = old
    for feed in feeds:
        table.merge(feed, sinks.upsert_cities)
        whole = sinks.upsert_cities(whole, feed)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, whole.collect()))


def test_a_merge_that_stops_changes_nothing(spark, table, monkeypatch):
    old = names(table)
    feed = cities(spark, ["00001", "x"], "new")
    with monkeypatch.context() as patch:
        patch.setattr(sinks.BucketTable, "_switch", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            table.merge(feed, sinks.upsert_cities)
    assert names(table) == old
    with pytest.raises(ValueError, match="does not touch"):
        table.merge(feed, lambda known, new: cities(spark, [f"{i:05d}" for i in range(2000)]))
    assert names(table) == old
    assert table.merge(feed, sinks.upsert_cities)["touched"] in (1, 2)
    assert names(table)["x"] == ("new x", "01")
    table.prune()
    assert names(table)["00001"] == ("new 00001", "01") and len(names(table)) == 2001


def test_the_second_of_two_writers_is_refused(spark, table):
    def slow(known, feed):  # another writer switches while this one works
        sinks.BucketTable(spark, table.root).merge(cities(spark, ["00007"], "first"), sinks.upsert_cities)
        return sinks.upsert_cities(known, feed)

    with pytest.raises(RuntimeError, match="another writer"):
        table.merge(cities(spark, ["00007"], "second"), slow)
    assert names(table)["00007"] == ("first 00007", "01")


def test_positions_and_empty_feeds_and_lookups(spark, tmp_path):
    table = sinks.BucketTable(spark, str(tmp_path / "names"))
    with pytest.raises(ValueError, match="no table"):
        table.read()
    known = spark.createDataFrame([], "code STRING, name STRING")
    assert table.create(known, ["code"], buckets=4) == 0 and table.read().count() == 0
    with pytest.raises(ValueError, match="there is a table"):
        table.create(known, ["code"])
    feed = spark.createDataFrame([("1", "z", 1), ("1", "a", 2), (None, "none", 3)], "code STRING, name STRING, at INT")
    last = functools.partial(sinks.upsert, keys=["code"], overwrite=["name"], order="at")
    table.merge(feed, last)
    assert {tuple(r) for r in table.read().collect()} == {("1", "a"), (None, "none")}
    assert table.merge(feed.limit(0), last) == {"touched": 0, "rows": 0}
    # numbers are taken as the text that the table has for a key
    numbers = spark.createDataFrame([(1, "b")], "code INT, name STRING")
    assert table.merge(numbers, sinks.upsert_names)["touched"] == 1
    assert [r["name"] for r in table.lookup({"code": "1"}).collect()] == ["b"]
    assert [r["name"] for r in table.lookup({"code": None}).collect()] == ["none"]
    assert table.lookup({"code": "2"}).count() == 0
    with pytest.raises(ValueError, match="names of folders"):
        sinks.BucketTable(spark, str(tmp_path / "x")).create(known.withColumn("hash_bucket", F.lit(1)), ["code"])


def test_answers_of_other_years_are_not_read(spark, tmp_path):
    path = str(tmp_path / "answers")
    matches = spark.createDataFrame(
        [(f"s{y}", y, 45.0 + i, 2.0, True) for i, y in enumerate((2018, 2019, 2020))],
        "id STRING, year INT, latitude DOUBLE, longitude DOUBLE, resolved BOOLEAN")
    assert sinks.record_geocodes(matches, path, dt.datetime(2024, 1, 1)) == 3
    sales = spark.createDataFrame(
        [("s2018", 2018, None, None), ("s2019", 2019, None, None), ("t", 2019, 1.0, 1.0)],
        "id STRING, year INT, latitude DOUBLE, longitude DOUBLE")
    sales.write.partitionBy("year").parquet(str(tmp_path / "sales"))
    rows = sinks.with_geocodes(spark.read.parquet(str(tmp_path / "sales")), sinks.read_geocodes(spark, path)).filter("year = 2019")
    assert {(r["id"], r["latitude"], r["geocoded_at"] is not None) for r in rows.collect()} == {("s2019", 46.0, True), ("t", 1.0, False)}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(year") == 2
