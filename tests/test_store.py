"""The sales store: one switch per year, deliveries by change, summaries that need no lots, small boxes."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from terrascope import sinks
from terrascope.functions.geometry import z_order
from terrascope.operators import sales as S
from terrascope.operators import summaries as U

NOW = dt.datetime(2024, 1, 1)
COLUMNS = ("id STRING, mutation_id STRING, mutation_date DATE, year INT, mutation_nature STRING, property_value DECIMAL(15,2), "
           "property_type STRING, built_surface DOUBLE, city_insee_code STRING, latitude DOUBLE, longitude DOUBLE")


def lots(spark, n, seed=1, years=(2018, 2019), sales=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        year = rng.choice(years)
        place = (None, None) if i % 9 == 0 else (45 + rng.randrange(40) / 1000, 2 + rng.randrange(40) / 1000 + 0.0003)
        rows.append((
            f"{seed}-{i}", f"m{rng.randrange(sales)}", dt.date(year, 1 + rng.randrange(12), 3), year,
            rng.choice(["Vente", "Vente", "Echange"]), Decimal(rng.choice([0, 9000, 100000, 120000, 250000])),
            rng.choice(["MAISON", "APPARTEMENT", "DEPENDANCE"]), rng.choice([None, 5.0, 50.0, 80.0]),
            rng.choice(["00001", "00002", "00003", None]), *place))
    return spark.createDataFrame(rows, COLUMNS)


def stats(df):
    return {(r["insee_code"], r["year"]): (r["transaction_count"], r["total_price"], round(r["total_residential_surface"], 6))
            for r in df.collect()}


def boom(x):
    def fail(frames):
        for frame in frames:
            if (frame["id"] == x).any():
                raise RuntimeError("stopped")
            yield frame

    return fail


def test_a_writer_that_stops_leaves_the_old_year_whole(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "store")
    store = sinks.YearStore(spark, root)
    old = lots(spark, 60)
    sinks.publish_years(store, old, [2018, 2019], NOW)
    held, figures = sorted(r["id"] for r in sinks.read_sales(spark, root).collect()), stats(sinks.read_city_stats(spark, root))
    new = lots(spark, 80, seed=2)
    # a task fails while files are written
    with pytest.raises(Exception, match="stopped"):
        sinks.publish_years(store, new.repartition(4).mapInPandas(boom("2-70"), new.schema), [2018, 2019], NOW)
    # all files are there, the writer ends before the switch
    with monkeypatch.context() as patch:
        patch.setattr(sinks.YearStore, "switch", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            sinks.publish_years(store, new, [2018, 2019], NOW)
        with pytest.raises(RuntimeError, match="killed"):
            sinks.replace_sales_year(new, root, 2018)
    # a head that was not renamed yet is no head
    (tmp_path / "store" / "_heads" / "year=2018" / ".half").write_text("{")
    assert sorted(r["id"] for r in sinks.read_sales(spark, root).collect()) == held
    assert stats(sinks.read_city_stats(spark, root)) == figures
    assert store.prune(2018) >= 4 and store.prune(2018) == 0
    assert sorted(r["id"] for r in sinks.read_sales(spark, root).collect()) == held
    sinks.publish_years(store, new, [2018, 2019], NOW)
    assert sinks.read_sales(spark, root).count() == 80
    assert stats(sinks.read_city_stats(spark, root)) == stats(S.city_year_stats(new))


def test_a_year_switches_with_its_statistics(spark, tmp_path):
    root = str(tmp_path / "store")
    store = sinks.YearStore(spark, root)
    sinks.publish_years(store, lots(spark, 50), [2018, 2019], NOW)
    sinks.publish_years(store, lots(spark, 30, seed=3), [2019], NOW)
    head = json.loads((tmp_path / "store" / "_heads" / "year=2019" / "00000002.json").read_text())
    assert len({f for folders in head["parts"].values() for f in folders}) == 1 and len(head["parts"]) == 5
    now = sinks.read_sales(spark, root)
    assert stats(sinks.read_city_stats(spark, root)) == stats(S.city_year_stats(now))
    assert sinks.read_sales(spark, root, [2019]).filter("id LIKE '1-%'").count() == 0
    sinks.truncate_year(spark, root, 2019)
    assert {y for _, y in stats(sinks.read_city_stats(spark, root))} == {2018}
    # the number of a head is taken once
    (tmp_path / "store" / "_heads" / "year=2018" / "00000002.json").mkdir()
    with pytest.raises(Exception):
        store.switch(2018, {"lots": []})


def test_deliveries_are_added_by_change(spark, tmp_path):
    root = str(tmp_path / "store")
    store = sinks.YearStore(spark, root)
    everything = lots(spark, 300, sales=60)
    parts = everything.randomSplit([0.5, 0.3, 0.2], 5)
    sinks.publish_years(store, parts[0], [2018, 2019], NOW, {"release": 1, "deliveries": ["a"]})
    for key, part in (("b", parts[1]), ("c", parts[2]), ("b", parts[1])):
        sinks.add_delivery(store, part, [2018, 2019], key, NOW)
    assert sinks.read_sales(spark, root).count() == 300
    assert stats(sinks.read_city_stats(spark, root)) == stats(S.city_year_stats(everything))
    direct = {tuple(r) for r in S.transaction_stats_by(everything, ["city_insee_code", "year"]).collect()}
    summary = sinks.read_prices(spark, root).withColumnRenamed("insee_code", "city_insee_code")
    assert {tuple(r) for r in U.stats_of_summary(summary, ["city_insee_code", "year"]).collect()} == direct
    assert sinks.compact_year(store, 2018, NOW) == sinks.read_sales(spark, root, [2018]).count()
    assert len(store.head(2018)["parts"]["lots"]) == 1 and store.head(2018)["notes"]["deliveries"] == ["a", "b", "c"]
    assert stats(sinks.read_city_stats(spark, root)) == stats(S.city_year_stats(everything))


def read_bytes(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalInputBytes()


def test_a_small_delivery_reads_little_of_a_large_year(spark, tmp_path):
    store = sinks.YearStore(spark, str(tmp_path / "store"))

    def many(low, high):
        return spark.range(low, high).select(
            F.col("id").cast("string").alias("id"), F.concat(F.lit("m"), F.col("id")).alias("mutation_id"),
            F.lit(dt.date(2019, 5, 5)).alias("mutation_date"), F.lit(2019).alias("year"), F.lit("Vente").alias("mutation_nature"),
            (F.col("id") % 1000 + 20000).cast("decimal(15,2)").alias("property_value"), F.lit("MAISON").alias("property_type"),
            F.lit(50.0).alias("built_surface"), F.lpad((F.col("id") % 500).cast("string"), 5, "0").alias("city_insee_code"),
            (F.rand(1) * 5 + 43).alias("latitude"), (F.rand(2) * 5).alias("longitude"))

    sinks.publish_years(store, many(0, 200_000), [2019], NOW, {"release": 1})
    size = sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet"))
    before = read_bytes(spark)
    sinks.add_delivery(store, many(199_999, 200_002), [2019], "late", NOW)  # one sale known, two new
    assert read_bytes(spark) - before < size / 4
    got = stats(sinks.read_city_stats(spark, store.root))
    assert sum(n for n, _, _ in got.values()) == 200_002
    assert got["00499", 2019][2] == 50.0 * 401  # the known sale has a second lot now
    late = store.head(2019)["parts"]["city_stats"][-1]
    assert store.read("city_stats", folders={2019: [late]}).count() == 3


@pytest.mark.parametrize("metric", S.HEAT_METRICS)
@pytest.mark.parametrize("box", [(45.0, 2.0, 45.04, 2.04), (45.0104, 2.0101, 45.0257, 2.0333), (45.01, 2.0103, 45.02, 2.0203),
                                 (50.0, 2.0, 51.0, 3.0), (45.2, 2.0, 45.1, 3.0)])
def test_cells_give_what_the_lots_give(spark, metric, box):
    first, second = lots(spark, 400, seed=4), lots(spark, 300, seed=5)
    every = first.unionByName(second)
    cells = U.heat_cells(first).unionByName(U.heat_cells(second))
    for level, step in ((3, 0.001), (2, 0.01)):
        direct = S.heat_points(every, box, metric, step)
        stored = U.heat_points_of_cells(cells, box, metric, level, lots=every)
        key = lambda r: (round(r["latitude"], 6), round(r["longitude"], 6), round(r["value"], 6), r["samples"])
        assert sorted(map(key, stored.collect())) == sorted(map(key, direct.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_summaries_read_no_lots(spark, tmp_path):
    root = str(tmp_path / "store")
    sinks.publish_years(sinks.YearStore(spark, root), lots(spark, 200), [2018, 2019], NOW)
    cities = spark.createDataFrame([("00001", "01"), ("00002", "02")], "insee_code STRING, department_code STRING")
    summary = sinks.read_prices(spark, root)
    for df in (U.stats_of_summary(S.attach_department(summary, cities), ["department_code"]),
               U.dept_stats_of_summary(summary, cities), U.stats_of_summary(U.summary_scope(summary, year=2018), []),
               U.heat_points_of_cells(sinks.read_cells(spark, root), (45.0, 2.0, 45.04, 2.05), "AVERAGE_PRICE")):
        assert "/store/lots" not in plan(df)
        assert not any("/lots/" in f for f in df.inputFiles())
    assert "PartitionFilters: [isnotnull(year" in plan(U.summary_scope(summary, year=2018))


def test_the_curve_keeps_neighbours_together(spark):
    corners = [(-90.0, -180.0), (-90.0, 180.0), (90.0, -180.0), (90.0, 180.0), (None, 1.0), (1.0, float("nan")), (99.0, 999.0)]
    df = spark.createDataFrame(corners, "a DOUBLE, o DOUBLE")
    got = [r[0] for r in df.select(z_order(F.col("a"), F.col("o"))).collect()]
    assert got[0] == 0 and got[0] < got[1] < got[2] < got[3] == 2 ** 52 - 1
    assert got[4] is None and got[5] is None and got[6] == got[3]


def test_a_small_box_skips_most_rows(spark, tmp_path):
    n = 400_000
    rows = spark.range(n).select(
        F.col("id"), F.lit(2019).alias("year"), (F.rand(3) * 10 + 41).alias("latitude"), (F.rand(4) * 10 - 5).alias("longitude"))
    store = sinks.YearStore(spark, str(tmp_path / "store"))
    sinks.replace_sales_year(rows, store.root, 2019)
    seen = S.in_viewport(store.read("lots"), 44.0, 0.0, 45.0, 1.0)
    found = seen.collect()
    assert len(found) == rows.filter("latitude BETWEEN 44 AND 45 AND longitude BETWEEN 0 AND 1").count()
    executed = seen._jdf.queryExecution().executedPlan()
    scans = executed.collectLeaves()
    read = sum(scans.apply(i).metrics().apply("numOutputRows").value() for i in range(scans.size()))
    assert len(found) <= read < n / 5


def test_lots_without_a_place_are_spread_over_files(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.col("id"), F.lit(2019).alias("year"), F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        *[F.sha2(F.concat(F.lit(k), F.col("id").cast("string")), 256).alias(f"text{k}") for k in range(4)])
    root = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sinks.replace_sales_year(rows, root, 2019) == 40_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen = sinks.read_sales(spark, root)
    assert set(seen.columns) == set(rows.columns)
    sizes = [r["count"] for r in seen.groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 2 and max(sizes) < 20_000 and sum(sizes) == 40_000


def test_the_place_on_the_curve_is_named_few_times(spark):
    plan = spark.range(1).select(z_order(F.rand(1), F.rand(2)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rand(1)") < 16  # doubling steps named it over 60 times
