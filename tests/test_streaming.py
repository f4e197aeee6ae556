import datetime as dt
import json
from decimal import Decimal

from pyspark.sql import functions as F

from terrascope import sinks, streaming
from terrascope.operators import sales as S

NOW = dt.datetime(2024, 1, 1)


def event(i, job="a", type_="RUNNING"):
    at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)
    return json.dumps({"type": type_, "job": job, "message": f"m{i}", "at": at.isoformat() + "Z"})


def drop(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def test_unreadable_payloads_are_ignored(spark, tmp_path):
    drop(tmp_path / "in", "a.json", event(1), "{broken", "", "[1]", event(2, type_="FAILED"))
    out = str(tmp_path / "out")
    streaming.run_append(streaming.job_events_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "c"))
    assert {(r["type"], r["message"]) for r in spark.read.parquet(out).collect()} == {("RUNNING", "m1"), ("FAILED", "m2")}


def test_recent_events_over_several_runs(spark, tmp_path):
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "c")
    for run, ids in enumerate([range(0, 5), range(20, 22), range(10, 13)]):
        drop(tmp_path / "in", f"{run}.json", *[event(i) for i in ids])
        streaming.recent_events(streaming.job_events_stream(spark, str(tmp_path / "in")), state, checkpoint, n=4)
    assert [r["message"] for r in streaming.read_recent(spark, state, 4).collect()] == ["m21", "m20", "m12", "m11"]


def test_job_state_survives_restarts(spark, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")
    for run, lines in enumerate([[event(5, "a", "RUNNING"), event(1, "b", "STARTING")],
                                 [event(3, "a", "STARTING"), event(9, "b", "COMPLETED")]]):
        drop(tmp_path / "in", f"{run}.json", *lines)
        stream = streaming.job_events_stream(spark, str(tmp_path / "in"))
        streaming.keep_latest(streaming.job_state_stream(stream), out, checkpoint)
    assert {(r["job"], r["type"]) for r in spark.read.parquet(out).collect()} == {("a", "RUNNING"), ("b", "COMPLETED")}


def test_web_vitals_need_name_value_and_id(spark, tmp_path):
    beacons = [{"name": "LCP", "value": 1.5, "id": "v1"}, {"name": " ", "value": 1, "id": "v2"}, {"name": "CLS", "id": "v3"},
               {"name": "CLS", "value": 0, "id": ""}, {"name": "INP", "value": 0.0, "id": "v5", "path": "/x", "ts": 7}]
    drop(tmp_path / "in", "a.json", *map(json.dumps, beacons), "oops")
    out = str(tmp_path / "out")
    streaming.run_append(streaming.web_vitals_stream(spark, str(tmp_path / "in")), out, str(tmp_path / "c"))
    assert {(r["id"], r["path"]) for r in spark.read.parquet(out).collect()} == {("v1", None), ("v5", "/x")}


def lots(spark, rows):
    return spark.createDataFrame(
        [(i, f"m{i}", dt.date(y, 6, 1), y, "Vente", Decimal(v), "MAISON", 50.0, "c1", "75001") for i, y, v in rows],
        "id BIGINT, mutation_id STRING, mutation_date DATE, year INT, mutation_nature STRING, property_value DECIMAL(15,2), "
        "property_type STRING, built_surface DOUBLE, city_insee_code STRING, postal_code STRING")


def test_landed_years_are_replaced_and_refreshed(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "c")
    tables = {"store": str(tmp_path / "store"), "rejected": str(tmp_path / "rejected")}

    def run():
        streaming.sales_refresh_stream(spark, landing, tables, checkpoint, NOW)
        return {r["year"]: r["transaction_count"] for r in sinks.read_city_stats(spark, tables["store"]).collect()}

    lots(spark, [(1, 2018, 100000), (2, 2019, 100000)]).write.partitionBy("year").parquet(landing)
    assert run() == {2018: 1, 2019: 1}
    # a second file of 2019 and a year without a partition
    more = lots(spark, [(3, 2019, 100000), (4, 2012, 100000)])
    more.write.mode("append").partitionBy("year").parquet(landing)
    assert run() == {2018: 1, 2019: 2}
    assert run() == {2018: 1, 2019: 2}
    assert sinks.read_sales(spark, tables["store"]).count() == 3
    assert [tuple(r)[:2] for r in spark.read.parquet(tables["rejected"]).collect()] == [(2012, 1)]


def test_geocoding_takes_the_whole_backlog_and_rewrites_no_sales(spark, tmp_path):
    table, answered = str(tmp_path / "tx"), str(tmp_path / "answers")
    nothing = {c: F.lit(None).cast(t) for c, t in (("latitude", "double"), ("longitude", "double"), ("geocoded_at", "timestamp"))}
    sinks.overwrite_years(lots(spark, [(i, 2018 + i % 2, 1) for i in range(10)]).withColumns(nothing), table)
    cities = spark.createDataFrame([("c1", "Paris")], "insee_code STRING, name STRING")
    answers = spark.createDataFrame([(i, 45.0, 2.0, 0.9 if i % 3 else 0.1) for i in range(8)],
                                    "id BIGINT, latitude DOUBLE, longitude DOUBLE, score DOUBLE")

    def merged():
        return sinks.with_geocodes(spark.read.parquet(table), sinks.read_geocodes(spark, answered))

    def run():
        tried = streaming.drain_geocoding(spark, table, cities, answers, answered, NOW)
        rows = merged().collect()
        assert len(rows) == 10
        return tried, sorted(r["id"] for r in rows if r["geocoded_at"]), sorted(r["id"] for r in rows if r["latitude"])

    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "tx").rglob("*.parquet")}
    assert run() == (10, list(range(10)), [1, 2, 4, 5, 7])
    assert run() == (0, list(range(10)), [1, 2, 4, 5, 7])
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "tx").rglob("*.parquet")} == before
    assert S.geocode_backlog_size(merged()).first()["backlog"] == 0


def test_the_newest_release_of_a_year_wins(spark, tmp_path):
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "c")
    tables = {"store": str(tmp_path / "store"), "rejected": str(tmp_path / "no")}

    def land(release, rows):
        lots(spark, rows).withColumn("release", F.lit(release)).write.mode("append").partitionBy("year", "release").parquet(landing)
        streaming.sales_refresh_stream(spark, landing, tables, checkpoint, NOW)
        return {r["year"]: r["transaction_count"] for r in sinks.read_city_stats(spark, tables["store"]).collect()}

    assert land(1, [(1, 2018, 100000), (2, 2019, 100000)]) == {2018: 1, 2019: 1}
    assert land(2, [(1, 2018, 100000), (3, 2018, 100000)]) == {2018: 2, 2019: 1}
    assert land(2, [(4, 2018, 100000)]) == {2018: 3, 2019: 1}
    assert land(1, [(5, 2018, 100000), (6, 2012, 100000), (7, 2031, 100000)]) == {2018: 3, 2019: 1}
    assert sorted((r["year"], r["rows"]) for r in spark.read.parquet(tables["rejected"]).collect()) == [(2012, 1), (2031, 1)]


def test_a_batch_is_read_for_its_files_only(spark, tmp_path, monkeypatch):
    from terrascope.streaming import drains

    read = []
    monkeypatch.setattr(drains, "publish_years", lambda store, rows, *rest: read.append(rows))
    landing = str(tmp_path / "a landing %41")
    for release in (1, 2):
        lots(spark, [(release, 2018, 100000), (3, 2019, 100000)]).withColumn("release", F.lit(release)).write.mode(
            "append").partitionBy("year", "release").parquet(landing)
    streaming.sales_refresh_stream(spark, landing, {"store": str(tmp_path / "store")}, str(tmp_path / "c"), NOW)
    assert sorted(r["id"] for r in read[0].collect()) == [2, 3]
    plan = read[0].select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan  # not every column of the batch


def test_equal_events_are_kept_and_old_versions_removed(spark, tmp_path):
    state, checkpoint = str(tmp_path / "state"), str(tmp_path / "c")
    for run in range(4):
        drop(tmp_path / "in", f"{run}.json", event(5, "a", "RUNNING"), event(5, "a", "RUNNING"))
        streaming.recent_events(streaming.job_events_stream(spark, str(tmp_path / "in")), state, checkpoint, n=5)
    assert streaming.read_recent(spark, state, 5).count() == 5
    assert sorted(p.name for p in (tmp_path / "state").iterdir()) == ["v2", "v3"]


def test_each_batch_writes_only_the_jobs_it_changes(spark, tmp_path, monkeypatch):
    from terrascope.streaming import feeds

    monkeypatch.setattr(feeds, "FULL_EVERY", 3)
    out, checkpoint, late = str(tmp_path / "out"), str(tmp_path / "c"), str(tmp_path / "late")
    deliveries = [
        [event(i, f"j{i}") for i in range(50)], [event(100, "j1", "FAILED"), event(2, "j5")], [event(101, "new")],
        [event(102, "j2"), event(3, "j7"), event(95, "j8")], [event(103, "j3")]]
    sizes = []
    for run, lines in enumerate(deliveries):
        drop(tmp_path / "in", f"{run}.json", *lines)
        stream = streaming.job_events_stream(spark, str(tmp_path / "in"))
        streaming.keep_job_states(stream, out, checkpoint, dt.timedelta(seconds=60), late)
        kind = "full" if run == 3 else "changed"
        sizes.append(spark.read.parquet(f"{out}/{kind}={run}").count())
    assert sizes == [50, 1, 1, 51, 1]
    states = {r["job"]: (r["type"], r["message"]) for r in streaming.read_job_states(spark, out).collect()}
    assert len(states) == 51 and states["j1"] == ("FAILED", "m100") and states["j8"] == ("RUNNING", "m95")
    assert states["j7"] == ("RUNNING", "m7") and states["j3"] == ("RUNNING", "m103")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["changed=4", "full=3"]
    aside = spark.read.parquet(late)
    assert [r["job"] for r in aside.collect()] == ["j7"]  # three seconds, with the newest at 101


def test_large_years_are_taken_one_by_one_and_replaced_ones_removed(spark, tmp_path, monkeypatch):
    from terrascope.streaming import drains

    groups, whole = [], drains.publish_years
    monkeypatch.setattr(drains, "publish_years", lambda store, rows, years, *rest: groups.append(years) or whole(store, rows, years, *rest))
    landing, store = str(tmp_path / "landing"), sinks.YearStore(spark, str(tmp_path / "store"))

    def land(release, **options):
        rows = lots(spark, [(10 * release, 2018, 100000), (10 * release + 1, 2019, 100000)])
        rows.withColumn("release", F.lit(release)).write.mode("append").partitionBy("year", "release").parquet(landing)
        streaming.sales_refresh_stream(spark, landing, {"store": store.root}, str(tmp_path / "c"), NOW, **options)

    def held():
        return [len(list((tmp_path / "store/lots" / f"year={y}").glob("folder=*"))) for y in (2018, 2019)]

    land(1)
    land(2)
    assert groups == [[2018, 2019], [2018, 2019]] and held() == [2, 2]
    monkeypatch.setattr(drains, "GROUP_BYTES", 1)
    land(3, keep_replaced=False)
    assert groups[2:] == [[2018], [2019]] and held() == [1, 1]
    assert sorted(r["id"] for r in store.read("lots").collect()) == [30, 31]
    assert {r["year"]: r["transaction_count"] for r in sinks.read_city_stats(spark, store.root).collect()} == {2018: 1, 2019: 1}


def test_a_store_leaves_no_shuffle_files(spark, tmp_path):
    import pathlib

    def files():
        at = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
        return {f.name for d in at for f in pathlib.Path(d.getPath()).rglob("shuffle_*.data")}

    before = files()
    sinks.YearStore(spark, str(tmp_path)).write("lots", lots(spark, [(i, 2019, 100) for i in range(50)]), "a", sort=["id"], by=["id"])
    assert not files() - before
