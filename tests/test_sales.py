import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from terrascope.operators import hierarchy as H
from terrascope.operators import paging as P
from terrascope.operators import ranking as R
from terrascope.operators import runs as J
from terrascope.operators import sales as S


def lots(spark, pairs, city="c1"):
    rows = [(i, city, None if p is None else Decimal(str(p)), None if s is None else float(s), dt.date(2020, 5, 1), 2020)
            for i, (p, s) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "id BIGINT, city_insee_code STRING, property_value DECIMAL(15,2), built_surface DOUBLE, "
              "mutation_date DATE, year INT")


def stats(spark, pairs):
    row = S.transaction_stats(lots(spark, pairs), None, city="c1").first().asDict()
    return {k: float(v) for k, v in row.items()}


def test_five_sales(spark):
    got = stats(spark, [(100000, 40), (150000, 55), (200000, 70), (250000, 90), (400000, 120)])
    ratio = sum([100000 / 40, 150000 / 55, 200000 / 70, 250000 / 90, 400000 / 120]) / 5
    assert got.pop("average_price_per_sqm") == pytest.approx(ratio)
    assert got == {"total_transactions": 5, "average_price": 220000, "median_price": 200000, "min_price": 100000,
                   "max_price": 400000, "average_surface": 75}


def test_even_count_takes_the_upper_middle(spark):
    assert stats(spark, [(p, None) for p in (100000, 200000, 300000, 400000)])["median_price"] == 300000


def test_mixed_validity(spark):
    got = stats(spark, [(100000, None), (None, None), (0, None), (300000, None)])
    assert (got["total_transactions"], got["average_price"], got["median_price"], got["min_price"], got["max_price"]) == (
        4, 200000, 300000, 100000, 300000)


def test_missing_surfaces(spark):
    got = stats(spark, [(200000, 80), (100000, None), (150000, 0)])
    assert (got["average_surface"], got["average_price_per_sqm"]) == (80, 2500)


def test_single_sale(spark):
    got = stats(spark, [(175000, 65)])
    assert {got[k] for k in ("average_price", "median_price", "min_price", "max_price")} == {175000}
    assert got["average_surface"] == 65


@pytest.mark.parametrize("pairs", [[], [(None, 50), (0, 60)]])
def test_nothing_valid_is_all_zeros(spark, pairs):
    assert set(stats(spark, pairs).values()) == {0}


def test_no_surface(spark):
    got = stats(spark, [(200000, None)])
    assert (got["average_surface"], got["average_price_per_sqm"]) == (0, 0)


def test_mean_is_rounded_half_up(spark):
    assert stats(spark, [("0.01", None), ("0.02", None)])["average_price"] == 0.02


def test_unscoped_stats_cover_the_table(spark):
    row = S.transaction_stats(lots(spark, [(100, 10)]), None, city=" ").first()
    assert row["total_transactions"] == 1 and row["max_price"] == 100


def test_price_overview_leaves_out_empty_groups(spark):
    tx = lots(spark, [(100, 10), (300, 10)]).unionByName(lots(spark, [(None, 5)], city="c2"))
    rows = S.price_overview(S.transaction_stats_by(tx, ["city_insee_code"]), ["city_insee_code"]).collect()
    assert {(r["city_insee_code"], r["label"], float(r["value"])) for r in rows} == {
        ("c1", "Average", 200), ("c1", "Median", 300), ("c1", "Min", 100), ("c1", "Max", 300)}


def test_upper_median_against_brute_force(spark):
    rng = random.Random(7)
    groups = {"hot": 3000, "small": 7, "one": 1, None: 40}
    rows = [(k, Decimal(rng.randrange(1, 10 ** rng.randrange(1, 15))) / 100) for k, n in groups.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "k STRING, v DECIMAL(15,2)")
    got = {r["k"]: r["median"] for r in R.upper_median(df, ["k"], "v").collect()}
    for k in groups:
        ordered = sorted(v for key, v in rows if key == k)
        assert got[k] == ordered[len(ordered) // 2]
    everything = sorted(v for _, v in rows)
    assert R.upper_median(df, [], "v").first()["median"] == everything[len(everything) // 2]


def test_rank_in_groups_equals_a_window(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", rng.randrange(20), f"w{i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "g STRING, n INT, w STRING")
    got = {(r["g"], r["w"]): r["rank"] for r in R.rank_in_groups(df, "g", [F.desc("n"), F.asc("w")]).collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[(g, r[2])] for r in ordered] == list(range(1, len(ordered) + 1))


def sale_lots(spark, rows):
    return spark.createDataFrame(
        [(m, dt.date(y, 3, 1), n, Decimal(str(v)) if v is not None else None, t, s, c) for m, y, n, v, t, s, c in rows],
        "mutation_id STRING, mutation_date DATE, mutation_nature STRING, property_value DECIMAL(15,2), "
        "property_type STRING, built_surface DOUBLE, city_insee_code STRING")


def test_a_sale_of_many_lots_counts_once(spark):
    tx = sale_lots(spark, [("m1", 2020, "Vente", 250000, "APPARTEMENT", 50.0, "75101")] * 73
                   + [("m1", 2020, "Vente", 250000, "DEPENDANCE", 500.0, "99999")])
    row = S.city_year_stats(tx, 2020).first()
    assert (row["insee_code"], row["transaction_count"], float(row["total_price"]), row["total_residential_surface"]) == (
        "75101", 1, 250000, 73 * 50)


def test_which_sales_are_left_out(spark):
    tx = sale_lots(spark, [
        ("nature", 2020, "Echange", 100000, "MAISON", 50.0, "a"), ("cheap", 2020, "Vente", 9999.99, "MAISON", 50.0, "a"),
        ("dear", 2020, "Vente", 5000000.01, "MAISON", 50.0, "a"), (None, 2020, "Vente", 100000, "MAISON", 50.0, "a"),
        ("tiny", 2020, "Vente", 100000, "MAISON", 8.9, "a"), ("huge", 2020, "Vente", 100000, "MAISON", 1000.1, "a"),
        ("other", 2020, "Vente", 100000, "LOCAL", 50.0, "a"), ("nowhere", 2020, "Vente", 100000, "MAISON", 50.0, None),
        ("early", 2019, "Vente", 100000, "MAISON", 50.0, "a"),
        ("low", 2020, "Vente", 10000, "MAISON", 9.0, "a"),
        ("high", 2020, "Vente en l'état futur d'achèvement", 5000000, "MAISON", 1000.0, "a")])
    assert {r["mutation_id"] for r in S.dedup_mutations(tx, 2020).collect()} == {"low", "high"}


def test_region_without_sales_is_kept(spark):
    regions = spark.createDataFrame([("1", "R1"), ("2", "R2")], "code STRING, name STRING")
    departments = spark.createDataFrame([("01", "D", "1")], "code STRING, name STRING, region_code STRING")
    cities = spark.createDataFrame([("c1", "C", "01")], "insee_code STRING, name STRING, department_code STRING")
    stats_ = spark.createDataFrame(
        [("c1", 2019, 2, Decimal(300), 10.0), ("c1", 2020, 1, Decimal(300), 20.0), ("ghost", 2020, 5, Decimal(1), 1.0)],
        "insee_code STRING, year INT, transaction_count BIGINT, total_price DECIMAL(20,2), "
        "total_residential_surface DOUBLE")
    rows = {r["code"]: r for r in H.region_stats(regions, departments, cities, stats_).collect()}
    assert (rows["1"]["transaction_count"], rows["1"]["average_price"], rows["1"]["average_price_per_sqm"]) == (3, 200, 20)
    assert (rows["2"]["transaction_count"], rows["2"]["average_price"]) == (0, None)
    codes = spark.createDataFrame([("c1",), ("c1",), ("zz",)], "code STRING")
    assert [r["code"] for r in H.city_stats(cities, stats_, codes).collect()] == ["c1"]
    assert H.city_stats(cities, stats_, codes.limit(0)).count() == 0


def test_city_search_priority(spark):
    cities = spark.createDataFrame(
        [("1", "Lyon", "69"), ("2", "Lyons-la-Forêt", "27"), ("3", "Caluire", "69")],
        "insee_code STRING, name STRING, department_code STRING")

    def found(**kw):
        return [r["insee_code"] for r in H.search_cities(cities, **kw).collect()]

    assert found(dept="69", query="LYON") == ["1", "2"]
    assert found(dept="69", query="  ") == ["1", "3"]
    assert found() == ["1", "2", "3"]
    assert found(query="%") == []


def test_place_search(spark):
    regions = spark.createDataFrame([("84", "Auvergne-Rhône-Alpes")], "code STRING, name STRING")
    departments = spark.createDataFrame([("69", "Rhône"), ("84", "Vaucluse")], "code STRING, name STRING")
    found = [(r["code"], r["level"]) for r in H.search_places(regions, departments, " rhône ").collect()]
    assert found == [("84", "REGION"), ("69", "DEPARTMENT")]
    assert [r["code"] for r in H.search_places(regions, departments, "8").collect()] == ["84"]
    assert H.search_places(regions, departments, " ").count() == 0
    assert H.search_regions(regions, "").count() == 0


def test_pages_cover_everything_once(spark):
    df = spark.range(45)
    ids = [r["id"] for n in range(3) for r in P.page(df, ["id"], n).collect()]
    assert ids == list(range(45))
    info = P.page_info(df, 2).first()
    assert (info["size"], info["total_elements"], info["total_pages"], info["number"]) == (20, 45, 3, 2)
    with pytest.raises(ValueError):
        P.page(df, ["id"], -1)


def test_viewport_guards(spark):
    df = spark.createDataFrame([(45.0, 2.0), (46.0, 2.0)], "latitude DOUBLE, longitude DOUBLE")
    assert S.in_viewport(df, 45.0, 2.0, 46.0, 3.0).count() == 2
    assert S.in_viewport(df, 46.0, 2.0, 45.0, 3.0).count() == 0
    assert S.in_viewport(df, 40.0, 2.0, 46.0, 3.0).count() == 2
    assert S.in_viewport(df, 40.0, 2.0, 46.0, 3.0, max_degrees=5.0).count() == 0


def test_heat_cells(spark):
    rows = [(45.0001, 2.0001, 100.0, 10.0), (45.0002, 2.0002, 300.0, None), (45.1, 2.1, 0.0, 10.0), (None, 2.0, 5.0, 5.0)]
    tx = spark.createDataFrame(rows, "latitude DOUBLE, longitude DOUBLE, property_value DOUBLE, built_surface DOUBLE")
    box = (44.0, 1.0, 46.0, 3.0)
    assert [(r["value"], r["samples"]) for r in S.heat_points(tx, box, "AVERAGE_PRICE").collect()] == [(200.0, 2)]
    assert [r["value"] for r in S.heat_points(tx, box, "AVERAGE_PRICE_PER_SQM").collect()] == [10.0]
    assert [r["value"] for r in S.heat_points(tx, box, "TRANSACTION_COUNT").collect()] == [2.0]
    with pytest.raises(ValueError):
        S.heat_points(tx, box, "OTHER")


def test_job_status(spark):
    t = dt.datetime(2024, 1, 1, 12)
    runs = spark.createDataFrame(
        [("a", 2020, t, t + dt.timedelta(seconds=90), "COMPLETED"), ("a", 2020, t + dt.timedelta(hours=1), None, "STARTED"),
         ("b", 2021, t, t + dt.timedelta(milliseconds=1500), "FAILED")],
        "job_name STRING, year INT, start_time TIMESTAMP, end_time TIMESTAMP, status STRING")
    rows = {r["job_name"]: (r["state"], r["last_status"], r["last_duration_ms"]) for r in J.job_status(runs).collect()}
    assert rows == {"a": ("RUNNING", "STARTED", None), "b": ("IDLE", "FAILED", 1500)}
    assert [(r["year"], r["last_duration_ms"]) for r in J.latest_runs(runs).collect()] == [(2020, 90000)]


def test_duplicate_geocoder_answers_do_not_multiply(spark):
    inputs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id BIGINT")
    answers = spark.createDataFrame(
        [(1, 45.0, 2.0, 0.9), (1, 46.0, 3.0, 0.5), (2, 45.0, 2.0, 0.39), (3, 45.0, 2.0, None)],
        "id BIGINT, latitude DOUBLE, longitude DOUBLE, score DOUBLE")
    rows = {r["id"]: (r["latitude"], r["resolved"]) for r in S.match_geocodes(inputs, answers).collect()}
    assert rows == {1: (45.0, True), 2: (45.0, False), 3: (45.0, True), 4: (None, False)}


def test_pages_follow_one_another(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(10)], "a BIGINT, id BIGINT")
    seen, after = [], None
    while rows := P.page_after(df, ["a", "id"], after, 4).collect():
        seen += [tuple(r) for r in rows]
        after = seen[-1]
    assert seen == sorted((i % 3, i) for i in range(10))


def test_a_page_keeps_its_order_after_the_join(spark):
    tx = spark.range(200).select(F.col("id"), (F.col("id") % 7).cast("string").alias("city_insee_code"), (500 - F.col("id")).alias("property_value"))
    cities = spark.createDataFrame([(str(i), f"c{i}") for i in range(7)], "insee_code STRING, name STRING")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        page = S.search_transactions(tx, cities, number=1, size=50, sort=["property_value"])
        assert [r["id"] for r in page.collect()] == list(range(149, 99, -1))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lower_median_is_exact(spark):
    df = spark.createDataFrame([("a", v) for v in (4.0, 1.0, 3.0, 2.0)] + [("b", v) for v in (7.0, 5.0, 6.0)], "k STRING, v DOUBLE")
    got = {r["k"]: float(r["median"]) for r in R.upper_median(df, ["k"], "v", lower=True).collect()}
    assert got == {"a": 2.0, "b": 6.0}


def test_department_stats_take_any_price(spark):
    rows = [("c1", v, 10.0) for v in (1e14, 1e14, float("nan"), float("inf"), -5.0, None, 0.001, 0.002, 250000.123)]
    rows += [("c2", v, None) for v in (1e300, 1e-300)] + [("c3", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "insee_code STRING, price DOUBLE, surface DOUBLE")
    mapping = spark.createDataFrame([("c1", "01"), ("c2", None), ("c3", "03")], "insee_code STRING, department_code STRING")
    got = {r["department_code"]: r for r in S.dept_sales_stats(df, mapping).collect()}
    assert set(got) == {"01", None}
    assert got["01"]["transaction_count"] == 5 and got["01"]["median_price"] == 250000.123
    assert got["01"]["avg_price"] == pytest.approx((2e14 + 250000.126) / 5)
    assert (got[None]["transaction_count"], got[None]["median_price"], got[None]["avg_price_per_sqm"]) == (2, 1e-300, None)


def test_a_long_commune_code_is_no_commune(spark):
    rows = [("m1", "97A123456"), ("m2", "00001"), ("m3", "00001"), ("m3", "00002000000")]
    tx = spark.createDataFrame(
        [(m, dt.date(2020, 1, 1), "Vente", Decimal(100000), "MAISON", 50.0, c) for m, c in rows],
        "mutation_id STRING, mutation_date DATE, mutation_nature STRING, property_value DECIMAL(15,2), "
        "property_type STRING, built_surface DOUBLE, city_insee_code STRING")
    assert [(r["insee_code"], r["transaction_count"]) for r in S.city_year_stats(tx).collect()] == [("00001", 2)]


def test_medians_of_any_numbers(spark):
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(501)] + [0.0] * 40 + [5e-324, -5e-324]
    df = spark.createDataFrame([("a", v) for v in values] + [("a", None), ("a", float("nan"))], "k STRING, v DOUBLE")
    ordered = sorted(values)
    for lower, at in ((False, len(ordered) // 2), (True, (len(ordered) + 1) // 2 - 1)):
        assert R.upper_median(df, ["k"], "v", lower=lower).first()["median"] == ordered[at]


def test_pages_after_a_null(spark):
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i) for i in range(20)], "a BIGINT, id BIGINT")
    seen, after = [], None
    while rows := P.page_after(df, ["a", "id"], after, 4).collect():
        seen += [tuple(r) for r in rows]
        after = seen[-1]
    assert len(seen) == 20 and seen == sorted(seen, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_lots_are_counted_before_they_meet_many_communes_of_a_code(spark):
    rows = spark.range(2000).select(
        F.lit("00001").alias("insee_code"), F.lit(100_000).cast("decimal(15,2)").alias("property_value"),
        F.lit(50.0).alias("built_surface"), F.lit(100_000.0).alias("price"), F.lit(50.0).alias("surface"))
    other = spark.createDataFrame([("00002", None, 9.0, None, 9.0), (None, None, 9.0, 1.0, 9.0)],
        "insee_code string, property_value decimal(15,2), built_surface double, price double, surface double")
    mapping = spark.range(300).select(
        F.lit("00001").alias("insee_code"), F.concat(F.lit("0"), (F.col("id") % 3).cast("string")).alias("department_code")
    ).unionByName(spark.createDataFrame([("00002", None), ("00002", "00"), ("00003", "07")], "insee_code string, department_code string"))
    lots = rows.unionByName(other)

    def most_joined(df):
        df.collect()
        most, nodes = 0, [df._jdf.queryExecution().executedPlan()]
        while nodes:
            node = nodes.pop()
            if "Join" in node.nodeName():
                most = max(most, node.metrics().apply("numOutputRows").value())
            nodes += [node.children().apply(i) for i in range(node.children().size())]
        return most

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        depts = S.dept_sales_stats(lots, mapping)
        stats = S.transaction_stats_by(lots, ["department_code"], mapping)
        assert 0 < most_joined(depts) < 2000 and 0 < most_joined(stats) < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {tuple(r) for r in depts.collect()} == {(f"0{d}", 200_000, 100_000.0, 2000.0, 100_000.0) for d in range(3)}
    plain = S.transaction_stats_by(S.attach_department(lots, mapping), ["department_code"])
    assert {tuple(r) for r in stats.collect()} == {tuple(r) for r in plain.collect()}
    assert stats.count() == 4


def _joined_rows(df):
    """Rows that the joins of an executed plan gave."""
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in kind:
            found += node.metrics().apply("numOutputRows").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def _of_many_places(spark):
    lots = spark.createDataFrame([(i, c) for i, c in enumerate(["a"] * 40 + ["b", "b", "none", None])], "id INT, code STRING")
    places = [("a", f"n{i % 150}", "01" if i % 3 else None) for i in range(200)] + [("b", None, "02"), (None, "x", "03")]
    return lots, spark.createDataFrame(places, "insee_code STRING, name STRING, department_code STRING")


def test_summary_multiplies_lots_behind_the_join(spark):
    lots, cities = _of_many_places(spark)
    tx = lots.withColumnRenamed("code", "city_insee_code")
    expected = tx.join(cities, F.col("insee_code") == F.col("city_insee_code"), "left").select("id", F.col("name").alias("city_name"), "city_insee_code")
    found = S.transaction_summary(tx, cities)
    assert found.columns == expected.columns
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, expected.collect()))
    assert _joined_rows(found) <= 40 * 5 + 4  # 200 places lie in five blocks at most


def test_departments_multiply_sales_behind_the_join(spark):
    lots, cities = _of_many_places(spark)
    sales = lots.withColumnRenamed("code", "insee_code")
    expected = sales.join(cities.select("insee_code", "department_code"), "insee_code")
    found = S.attach_department(sales, cities)
    assert found.columns == expected.columns
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, expected.collect()))
    assert _joined_rows(found) <= 40 * 5 + 2
