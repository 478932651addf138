"""The whole build on tiny raw files."""

import json
import math
from datetime import date, timedelta

import pytest

from epitide import schema
from epitide.plans import build


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(header), *(",".join("" if v is None else str(v) for v in r) for r in rows)]) + "\n", encoding="utf-8")
    return str(path)


def raw_files(spark, root):
    days = [date(2020, 1, 1) + timedelta(days=i) for i in range(120)]
    codes = {"AAA": "Aland", "BBB": "Bland"}
    locations = write(root / "locations.csv", ["location", "location_code", "representative_city", "latitude", "longitude", "enabled"],
                      [["Aland", "aaa", "A City", 1.5, 2.5, "true"], ["Bland", "BBB", "B City", "x", 4, "yes"], ["Off", "CCC", "C", 1, 1, "false"]])
    published = write(root / "published.csv", ["country", "date", "code", "total_cases", "new_cases"],
                      [[name, d, code, 10 * (i + 1), None if i % 5 else 10 + (i % 7)] for code, name in codes.items() for i, d in enumerate(days)])
    header = [f.name for f in schema.WEATHER_SCHEMA.fields]
    for code, name in codes.items():
        write(root / "weather" / code / f"{code}_2020.csv", header, [[d, name, code, "City", 1, 2, 10 + math.sin(i), 20, 1, 0.5, 60, 3, "api", "UTC", "2026-01-01T00:00:00"] for i, d in enumerate(days)])
    pop_header = [f'"{f.name}"' for f in schema.POPULATION_SCHEMA.fields]
    population = write(root / "population.csv", pop_header, [[1, code, name, "Cap", "Europe", *([1000 + k for k in range(8)]), 10.0, 100.0, 1.01, 0.1] for code, name in codes.items()])
    mapping = write(root / "mapping.csv", [f.name for f in schema.NAME_MAPPING_SCHEMA.fields], [["A-land", "Aland", "Aland", "AAA", "true", ""], ["Ship", "", "Ship", "", "false", "x"]])
    reports = write(root / "reports.csv", [f.name for f in schema.CASE_REPORT_SCHEMA.fields],
                    [[i, d.strftime("%m/%d/%Y"), "", "A-land", f"{d} 10:00:00", 10 * (i + 1), 0, 0] for i, d in enumerate(days)])
    hospital = write(root / "hospital.csv", ["Week Ending Date", "Geographic aggregation", "Total Influenza Admissions", "Percent Beds"], [[date(2024, 1, 6) + timedelta(days=7 * i), "USA", 100 + i, 0.25] for i in range(20)])
    annual = write(root / "annual" / "1.csv", ["Entity", "Code", "Year", "Incidence"], [["Aland", "aaa", y, 30 + y - 2010] for y in range(2010, 2021)] + [["Off", "CCC", 2010, 1], ["Bland", "BBB", 2015, ""]])
    deaths = write(root / "annual" / "2.csv", ["Entity", "Code", "Year", "Young", "Old"], [["Aland", "AAA", y, 2, y - 2000 if y < 2020 else ""] for y in range(2010, 2021)])
    raw = {"Id": 1, "SpatialDim": "AAA"}
    quoted = '"' + json.dumps(raw).replace('"', '""') + '"'
    for stamp, value in (("20260101T000000Z", 5), ("20260201T000000Z", 7)):
        write(root / "indicators" / f"who_hiv_HIV_0000000026_{stamp}.csv", list(schema.INDICATOR_COLUMNS),
              [["GHO", "HIV_0000000026", "HIV_0000000026", "Number of new HIV infections", "AAA", None, "COUNTRY", 2020, value, value, 1, 9, None, None, None, None, quoted]])
    pages = root / "pages.jsonl"
    pages.write_text(json.dumps({"page_url": "https://x.test/a/", "anchor_title": "法定传染病", "attachment_urls": [], "local_attachment_paths": []}, ensure_ascii=False) + "\n", encoding="utf-8")
    hourly = {n: write(root / "hourly" / f"{n}.csv", ["datetime", "New York", "Far"], [[f"2020-12-{d:02d} 0{h}:00:00", 280.15 + d, 1] for d in range(1, 4) for h in range(3)]) for n in ("temperature", "humidity")}
    return build.RawFiles(
        locations, 2026, mapping, reports, published, str(root / "weather"), population, None, hospital, str(root / "indicators"), str(pages),
        spark.createDataFrame([("none",)], "path string"), hourly, {"AAA": ["New York"]}, annual=build.AnnualFile(annual), annual_extra={"deaths_all_ages": build.AnnualFile(deaths), "old_only": build.AnnualFile(deaths, ["Old"])},
    )


def test_build_all(spark, tmp_path):
    out = str(tmp_path / "out")
    done = build.build_all(spark, raw_files(spark, tmp_path / "raw"), out, trees=2)
    silver = {name: spark.read.parquet(path) for name, path in done["silver"].items()}
    assert {r["location_code"] for r in silver["locations"].collect()} == {"AAA", "BBB"}
    assert silver["epidemic"].count() == 120 and silver["validation"].count() == 120 and silver["weather"].count() == 240
    assert silver["published"].count() == 240 and silver["hospital"].count() == 20
    assert [r["value"] for r in silver["primary"].collect()] == [7.0]
    assert silver["report_pages"].first()["record_role"] == "listing"
    assert silver["hourly_annual"].first()["temperature_mean"] == pytest.approx(9.0)
    annual = {r["year"]: r for r in silver["annual"].collect()}
    assert len(annual) == 11 and {r["location_code"] for r in annual.values()} == {"AAA"}
    assert (annual[2010]["value"], annual[2010]["new_deaths"], annual[2010]["old_only"], annual[2020]["new_deaths"], annual[2020]["old_only"]) == (30.0, 12.0, 10.0, 2.0, None)
    assert silver["reconciliation"].first()["overlap_rows"] == 120 and silver["reconciliation"].first()["median_relative_difference"] == 0
    assert {r["Percent Beds"] for r in silver["hospital_shares"].collect()} == {25.0}
    ledger = {r["part"]: r for r in silver["ledger"].collect()}
    assert ledger["owid"]["rows"] == 240 and ledger["who"]["primary_rows"] == 1 and ledger["tuberculosis"]["rows"] == 11
    features = spark.read.parquet(done["gold"])
    assert {(r["frequency"], r["rolling_label"]) for r in features.where("disease = 'Tuberculosis'").collect()} == {("annual", schema.FREQUENCY_LABELS["annual"]["rolling_label"])}
    # One daily value is missing: the first total has no difference and day 0 is published.
    assert features.groupBy("disease").count().count() == 4
    assert features.where("disease = 'COVID-19' AND has_weather").count() == features.where("disease = 'COVID-19'").count()
    assert features.where("disease = 'HIV/AIDS'").first()["weather_source"] == "hourly archive"
    documents = done["serving"]
    trend = spark.read.json(documents["trend"])
    assert trend.count() == 5 and trend.where("location_code = 'AAA' AND disease = 'COVID-19'").selectExpr("size(points)").first()[0] == 120
    overview = spark.read.json(documents["overview"]).first()
    assert overview["diseases"] == 4 and overview["data_completeness"] == 1.0 and overview["risk_comparison_regions"] == 2 and overview["best_model_mae"] >= 0
    status = {r["rule"]: r["status"] for r in spark.read.json(documents["source_status"]).collect()}
    assert status == {"ok": "ok", "index": "info", "catalog": "ok", "archive": "ok"}
    pages = spark.read.json(documents["option_pages"]).where("disease = 'COVID-19'").collect()
    assert [(r["page"], r["entry_count"], r["first_location_code"], r["last_location_code"]) for r in pages] == [(0, 2, "AAA", "BBB")]
    models = {r["model"] for r in spark.read.json(documents["model_metrics"]).where("disease = 'COVID-19'").collect()}
    assert models == {"naive_last_value", "moving_average", "gbt"}
    risk = {r["location_code"]: r["risk_comparable"] for r in spark.read.json(documents["risk_map"]).where("disease = 'Influenza'").collect()}
    assert risk == {"USA": False}
    assert spark.read.option("header", True).csv(done["csv"]["published"]).count() == 240
