import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from terrascope import sinks, sources
from terrascope.operators import sales as S


def sale(**kw):
    """One raw line of forty fields."""
    given = {"id_mutation": "2020-1", "date_mutation": "2020-03-01", "nature_mutation": "Vente", "valeur_fonciere": "100000",
             "code_commune": "75101", "code_departement": "75", "id_parcelle": "75101000AB0012", "nombre_lots": "1",
             "type_local": "Maison", "surface_reelle_bati": "50", "nombre_pieces_principales": "3", **kw}
    fields = [""] * 40
    for name, value in given.items():
        fields[sources.sales.SALES_POSITIONS[name]] = value
    return ",".join(fields)


HEADER = ",".join(f"h{i}" for i in range(40))


@pytest.fixture
def cities(spark):
    return spark.createDataFrame([("75101", "75"), ("01001", "01")], "insee_code STRING, department_code STRING")


def write(path, *lines):
    path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return str(path)


def imported(spark, cities, path, year=2020):
    return sources.import_sales(spark, path, year, cities).collect()


def test_clean_row(spark, tmp_path, cities):
    row = imported(spark, cities, write(tmp_path / "s.csv", sale(valeur_fonciere='"1234,56"', surface_terrain='"12,5"')))[0]
    assert (row["mutation_id"], str(row["mutation_date"]), row["year"]) == ("2020-1", "2020-03-01", 2020)
    assert (float(row["property_value"]), row["land_surface"], row["section"], row["plan_number"]) == (1234.56, 12.5, "00AB", "0012")
    assert (row["property_type"], row["street_type"], row["city_insee_code"]) == ("MAISON", None, "75101")


def test_refused_rows(spark, tmp_path, cities):
    good = sale(id_mutation="ok")
    path = write(
        tmp_path / "s.csv", good, ",".join(good.split(",")[:37]), sale(date_mutation="01/03/2020"),
        sale(valeur_fonciere="abc"), sale(id_parcelle="AB0012"), sale(id_parcelle="1AB0012"), sale(nature_mutation=""),
        sale(date_mutation="2019-03-01"), sale(id_mutation="short parcel", id_parcelle="12345"),
        ",".join(sale(id_mutation="38 fields").split(",")[:38]), sale(id_mutation="no value", valeur_fonciere=""),
        sale(id_mutation="quoted", type_local='"Local industriel. commercial ou assimilé"', nombre_lots='" 4 "'),
        sale(id_mutation="more") + ",x,y", sale(id_mutation="comma", adresse_numero='"1,2,3"'))
    rows = {r["mutation_id"]: r for r in imported(spark, cities, path)}
    assert set(rows) == {"ok", "short parcel", "38 fields", "no value", "quoted", "more", "comma"}
    assert rows["short parcel"]["section"] is None
    assert (rows["quoted"]["property_type"], rows["quoted"]["lot_count"]) == ("LOCAL", 4)
    assert rows["comma"]["street_number"] == "1,2,3"


def test_a_short_row_with_quoted_commas_is_still_short(spark, tmp_path, cities):
    short = ",".join(sale().split(",")[:9]) + ',"' + "," * 60 + '"'
    assert imported(spark, cities, write(tmp_path / "s.csv", short)) == []


def test_commune_codes_are_completed_and_looked_up(spark, tmp_path, cities):
    path = write(tmp_path / "s.csv", sale(id_mutation="a", code_commune="1", code_departement="1"),
                 sale(id_mutation="b", code_commune="99999"), sale(id_mutation="c", code_commune=""))
    assert {r["mutation_id"]: r["city_insee_code"] for r in imported(spark, cities, path)} == {"a": "01001", "b": None, "c": None}


def test_gzip_and_zip_give_the_same_rows(spark, tmp_path, cities):
    lines = [sale(id_mutation=f"m{i}") for i in range(50)] + ["too,short"]
    plain = write(tmp_path / "plain.csv", *lines)
    text = open(plain, encoding="utf-8").read()
    gz, archive = tmp_path / "s.csv.gz", tmp_path / "s.zip"
    gz.write_bytes(gzip.compress(text.encode()))
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("a.csv", text)
        z.writestr("b.csv", "\n".join([HEADER, sale(id_mutation="second")]))
        z.writestr("notes.txt", text)
    expected = {r["mutation_id"] for r in imported(spark, cities, plain)}
    assert {r["mutation_id"] for r in imported(spark, cities, str(gz))} == expected
    zipped = {r["mutation_id"] for r in sources.import_sales_zip(spark, str(archive), 2020, cities).collect()}
    assert zipped == expected | {"second"}


def test_ids_are_stable(spark, tmp_path, cities):
    path = write(tmp_path / "s.csv", sale(id_mutation="a"), sale(id_mutation="b"))
    first, again = ({r["mutation_id"]: r["id"] for r in imported(spark, cities, path)} for _ in range(2))
    assert first == again and len(set(first.values())) == 2


def test_scan_turns_garbage_into_null(spark, tmp_path):
    (tmp_path / "s.csv").write_text("code_commune,valeur_fonciere,surface_reelle_bati,date_mutation\n75101,abc,5,x\n,7.5,,y\n")
    rows = {r["date"]: (r["price"], r["surface"]) for r in sources.scan_sales_csv(spark, str(tmp_path / "s.csv")).collect()}
    assert rows == {"x": (None, 5.0), "y": (7.5, None)}


def test_energy_pages_have_their_own_headers(spark, tmp_path):
    for i, body in enumerate(['"75101",A,B,1990\n75101,,B,1990\n', " ,A,B\n75102,C,D\n75103,A\n"]):
        (tmp_path / f"page{i}.csv").write_text("code,dpe,ges,year\n" + body)
    rows = sources.scan_energy_pages(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in rows} == {("75101", "A", "B", 1990), ("75102", "C", "D", None)}


def test_health(spark, tmp_path):
    def line(year="2020", pathology="p", dept="01", prevalence="1,5"):
        return ";".join([year, pathology] + ["x"] * 6 + [dept, "x", "x", prevalence])
    path = tmp_path / "h.csv"
    path.write_text("\n".join(["h", line(), line(year="x"), line(pathology=" "), line(dept=""), line(prevalence="n/a"), "a;b"]))
    assert [tuple(r) for r in sources.scan_health(spark, str(path)).collect()] == [(2020, "p", "01", 1.5)]


def test_indicators_and_audit(spark, tmp_path):
    path = tmp_path / "i.csv"
    path.write_text("code,year,value,label,unit\n75101,2020,\"1,5\",Rate,%\n75101,,2,Rate\n,2020,1,Rate,%\n75101,2020,x,Rate,%\n"
                    "75101,2020,1,,%\n75101,2020\n")
    rows = sources.import_indicators(spark, str(path), "ECONOMY").collect()
    assert {(r["value"], r["year"], r["unit"]) for r in rows} == {(1.5, 2020, "%"), (2.0, None, None)}
    audit = S.import_audit(sources.parse_indicators(spark, str(path), "ECONOMY")).first()
    assert (audit["accepted"], audit["skipped"]) == (2, 4)
    with pytest.raises(ValueError):
        sources.import_indicators(spark, str(path), "WEATHER")


def test_reference_feeds(spark, tmp_path):
    def feed(name, rows):
        (tmp_path / name).write_text(json.dumps(rows))
        return str(tmp_path / name)
    regions = sources.scan_regions_json(spark, feed("r.json", [{"code": "1", "nom": "R"}, {"code": "", "nom": "x"}, {"code": "2", "nom": None}]))
    assert [tuple(r) for r in regions.collect()] == [("1", "R")]
    departments = sources.scan_departments_json(
        spark, feed("d.json", [{"code": "01", "nom": "A", "codeRegion": "1"}, {"code": "02", "nom": "B", "codeRegion": "9"}]), regions)
    assert [r["code"] for r in departments.collect()] == ["01"]
    communes = sources.scan_communes_json(spark, feed("c.json", [
        {"code": "01001", "nom": "C", "codesPostaux": ["01000", "01001"], "codeDepartement": "01", "population": 5, "surface": 2.5,
         "centre": {"type": "Point", "coordinates": [4.5, 46.1]}},
        {"code": "01002", "nom": "D", "codesPostaux": [], "codeDepartement": "01", "centre": {"type": "Point", "coordinates": [4.5]}},
        {"code": "02001", "nom": "E", "codeDepartement": "02"}]), departments)
    rows = {r["insee_code"]: r for r in communes.collect()}
    assert set(rows) == {"01001", "01002"}
    assert (rows["01001"]["postal_code"], rows["01001"]["longitude"], rows["01001"]["latitude"]) == ("01000", 4.5, 46.1)
    assert (rows["01002"]["postal_code"], rows["01002"]["longitude"]) == (None, None)


def test_geojson_documents(spark, tmp_path):
    square = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]}
    features = [{"type": "Feature", "properties": {"code": "01", "nom": "Ain"}, "geometry": square},
                {"type": "Feature", "properties": {"code": " ", "nom": "x"}, "geometry": square}]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    row = sources.scan_boundaries(spark, str(tmp_path / "b.geojson"), "DEPARTMENT").collect()
    assert len(row) == 1 and json.loads(row[0]["geometry"]) == square
    with pytest.raises(ValueError):
        sources.scan_boundaries(spark, "x", "PLANET")
    features = [{"type": "Feature", "geometry": square, "properties": {
        "ISO_A3": "-99", "ISO_A3_EH": "FRA", "ADM0_A3": "FRX", "NAME": "France", "POP_EST": 67.0, "GDP_MD": 2.5, "OTHER": 1}}]
    (tmp_path / "c.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    country = sources.scan_countries(spark, str(tmp_path / "c.geojson")).first()
    assert (country["code"], country["name"], country["population"], country["gdp"]) == ("FRA", "France", 67, 2.5)
    assert country["area"] == pytest.approx(12363.7, abs=0.1) and "other" not in country.asDict()


def test_geocodes(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text("id;street;latitude;longitude;result_score\n1;x;45.1;2.1;0.9\nbad;x;45;2;1\n2;x;n/a;2.2;\n;x;1;1;1\n")
    assert {tuple(r) for r in sources.scan_geocodes(spark, str(path)).collect()} == {(1, 45.1, 2.1, 0.9), (2, None, 2.2, None)}


def communes(n, indent=None):
    return json.dumps([{
        "code": f"{i:05d}", "nom": f'Ville "{i}" {{"code": [}},', "codesPostaux": [f"{i:05d}"], "codeDepartement": "01",
        "population": i, "surface": 1.5, "centre": {"type": "Point", "coordinates": [i / 10, 45.0]}} for i in range(n)], indent=indent)


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "16384")
    yield
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("indent", [None, 2])
def test_one_array_file_is_read_by_many_tasks(spark, tmp_path, small_splits, indent):
    (tmp_path / "a.json").write_text(communes(3000, indent))
    departments = spark.createDataFrame([("01",)], "code STRING")
    rows = sources.scan_communes_json(spark, str(tmp_path), departments)
    raw = sources.read_json_records(spark, str(tmp_path), "code STRING, population BIGINT")
    assert raw.rdd.getNumPartitions() > 10
    assert [(r.code, r.population) for r in raw.orderBy("code").collect()] == [(f"{i:05d}", i) for i in range(3000)]
    got = {r["insee_code"]: r for r in rows.collect()}
    assert len(got) == 3000 and got["00017"]["longitude"] == 1.7 and got["00017"]["name"] == 'Ville "17" {"code": [},'


@pytest.mark.parametrize("indent", [None, 1])
def test_one_feature_collection_is_read_by_many_tasks(spark, tmp_path, small_splits, indent):
    features = [{"type": "Feature", "properties": {"code": str(i), "nom": f"n{i}"},
                 "geometry": {"type": "Polygon", "coordinates": [[[i, 0], [i, 1], [i + 1, 1], [i, 0]]]}} for i in range(900)]
    whole = {"type": "FeatureCollection", "name": "x", "features": features, "crs": {"features": "none"}}
    (tmp_path / "a.geojson").write_text(json.dumps(whole, indent=indent))
    (tmp_path / "b.geojson").write_text(json.dumps({**whole, "features": []}))
    (tmp_path / "c.geojson.gz").write_bytes(gzip.compress(json.dumps({**whole, "features": [
        {"properties": {"nom": "other", "code": "x"}, "geometry": None, "type": "Feature"}]}).encode()))
    rows = sources.scan_boundaries(spark, str(tmp_path), "CITY")
    got = {r["geographic_code"]: r for r in rows.collect()}
    assert set(got) == {str(i) for i in range(900)} | {"x"} and rows.rdd.getNumPartitions() > 5
    assert json.loads(got["7"]["geometry"])["coordinates"][0][1] == [7, 1] and got["x"]["geometry"] is None


def test_records_that_start_otherwise_are_kept(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"code":"1","nom":"a"},\n{"nom":"b","code":"2"}, {"nom":"c","code":"3"},{"code":"4","nom":"d"}]\n')
    assert sorted(r["code"] for r in sources.scan_regions_json(spark, str(tmp_path)).collect()) == ["1", "2", "3", "4"]
    (tmp_path / "a.json").write_text('[{"code":"1","nom":{"code":"inner"}},{"code":"2","nom":"b"}]')
    with pytest.raises(Exception, match="not a whole record"):
        sources.scan_regions_json(spark, str(tmp_path)).collect()
    (tmp_path / "a.json").write_text('{"code":"1"}\n{"code":"2"}')
    with pytest.raises(ValueError, match="no array"):
        sources.scan_regions_json(spark, str(tmp_path))
    (tmp_path / "a.json").write_text(" [ ]")
    assert sources.scan_regions_json(spark, str(tmp_path)).count() == 0


def test_the_last_record_of_a_feed_wins(spark, tmp_path, small_splits):
    feed = [{"code": str(i % 50), "nom": f"{(i * 7919) % 10007} {i}"} for i in range(2000)]
    (tmp_path / "a.json").write_text(json.dumps(feed))
    known = spark.createDataFrame([("1", "old", "r")], "code STRING, name STRING, region_code STRING")
    rows = sources.scan_regions_json(spark, str(tmp_path), position="at")
    merged = sinks.upsert(known, rows, ["code"], ["name"], order="at").collect()
    assert {r["code"]: r["name"] for r in merged} == {f["code"]: f["nom"] for f in feed}


def test_zip_entries_are_read_from_their_place(spark, tmp_path, cities):
    for k in range(2):
        with zipfile.ZipFile(tmp_path / f"a{k}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for e in range(3):
                z.writestr(f"{e}.csv", "h\n" + "\n".join(sale(id_mutation=f"m{k}-{e}-{i}") for i in range(50)))
            z.writestr("notes.txt", "x")
    entries = sources.zip_entries(spark, [str(tmp_path / f"a{k}.zip") for k in range(2)])
    assert sorted(r["entry"] for r in entries.collect()) == sorted(["0.csv", "1.csv", "2.csv"] * 2)
    by_entry, by_archive = (
        sorted(r["mutation_id"] for r in sources.import_sales_zip(spark, str(tmp_path), 2020, cities, ranged=ranged).collect())
        for ranged in (True, False))
    assert by_entry == by_archive and len(by_entry) == 300


def test_equal_rows_get_different_ids_however_many(spark, cities):
    from terrascope.sources.sales import _identified

    rows = spark.range(0, 3000, 1, 7).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("x"))
    got = [r["id"] for r in _identified(rows).collect()]
    assert len(set(got)) == 3000 and {i.split("-")[1] for i in got} == {str(k) for k in range(1, 1001)}


def test_zip_entries_are_dealt_over_tasks_and_lines_parsed_once(spark, tmp_path):
    for k in range(8):
        with zipfile.ZipFile(tmp_path / f"a{k}.zip", "w") as z:
            for name in ("x.csv", "y.csv"):
                z.writestr(name, "h\n" + "\n".join(f"{k}{name}{i}" for i in range(20)) + "\n")
    files = [str(tmp_path / f"a{k}.zip") for k in range(8)]
    entries = sources.zip_entries(spark, files)
    assert entries.select(F.spark_partition_id()).distinct().count() > 1
    lines = sources.sales._spread_entries(entries)
    assert lines.distinct().count() == lines.count() == 8 * 2 * 20
    assert lines.select(F.spark_partition_id()).distinct().count() > 4
    one = sources.sales._spread_entries(sources.zip_entries(spark, files[:1]))  # fewer entries than task slots
    assert one.count() == 40 and one.select(F.spark_partition_id()).distinct().count() > 2
    parsed = sources.sales._named(sources.delimited.parse_positional(lines, 40, 38))
    plan = sources.clean_sales(parsed).filter("year = 2019")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_csv") == 1


def test_only_lines_of_the_year_are_parsed(spark, tmp_path, monkeypatch):
    from terrascope.sources import sales as X

    def line(*first, width=40):
        return ",".join([*first, *[""] * (width - len(first))])

    rows = [
        line("a", "2019-05-06", "", "Vente", "1,5"), line("b", "2018-05-06", "", "Vente", "2"),
        line("c", '"20""19-05-06"', "", "Vente", '"1,5"'), line("d", " 2019-05-06 ", "", "Vente\u0001x", "3"),
        line("e", "2019-05-06", "", "Vente", "4", width=20), line("f", "2019-05-06", "", '"Vente, en bloc"', "5", width=39),
        line("g", "2018-05-06", "", "Vente 2019-1", "6"), "", "   ", line("h", "2019-05-06", "", "Vente", '"7'),
    ]
    for k, end in enumerate(("\n", "\r\n")):
        header = line("h0", "2019-05-06", "", "Vente", "9")  # a header is no data, whatever it says
        (tmp_path / f"{k}.csv").write_bytes((end.join([header, *rows]) + end).encode())
    cities = spark.createDataFrame([("75001",)], "insee_code string")
    whole, seen = X.parse_positional, []
    monkeypatch.setattr(X, "parse_positional", lambda lines, *rest: seen.append(lines) or whole(lines, *rest))
    got = [tuple(r) for r in X.import_sales(spark, str(tmp_path), 2019, cities).collect()]
    expected = [tuple(r) for r in X._finish(X.scan_sales_positions(spark, str(tmp_path)), 2019, cities).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert len(got) > 6 and seen[0].count() == 14
