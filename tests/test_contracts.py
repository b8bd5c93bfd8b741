"""Inputs that must stop a job: each operator on a failing and on a sound one."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pitcast.operators import asof, disaggregate
from pitcast.plans import jobs
from pitcast.sources import dimensions, payloads, vendors


def test_mixed_offsets_stop_the_report(spark):
    rows = lambda *texts: spark.createDataFrame([("a", t) for t in texts], "report string, timestamp string")
    assert vendors.valid_instant(rows("2026-01-01T00:00:00", "2026-01-01T01:00:00")).count() == 2
    assert vendors.valid_instant(rows("2026-01-01T00:00:00Z", "2026-01-01T01:00:00+01:00")).count() == 2
    mixed = rows("2026-01-01T00:00:00Z", "2026-01-01T01:00:00")
    with pytest.raises(Exception, match="cannot mix"):
        vendors.valid_instant(mixed).collect()
    with pytest.raises(Exception, match="cannot mix"):
        vendors.valid_instant(mixed, report=["report"]).collect()
    two = mixed.withColumn("report", F.col("timestamp"))
    assert vendors.valid_instant(two, report=["report"]).count() == 2
    with pytest.raises(Exception, match="unreadable"):
        vendors.valid_instant(rows("2026-01-01T00:00:00", None)).collect()


AUTUMN = [("2025-11-02", h) for h in ("1:00", "1:00", "2:00")]


def test_the_repeated_hour_needs_both_passes_in_order(spark):
    def report(hours):
        return spark.createDataFrame([(d, h, i) for i, (d, h) in enumerate(hours)], "delivery_date string, hour_ending string, line int")

    got = vendors.valid_instant(report(AUTUMN), "line").orderBy("line").collect()
    assert [r["valid_at"].hour for r in got] == [6, 7, 8]
    with pytest.raises(Exception, match="Ambiguous"):
        vendors.valid_instant(report(AUTUMN)).collect()
    with pytest.raises(Exception, match="Ambiguous"):
        vendors.valid_instant(report(AUTUMN[1:]), "line").collect()
    assert vendors.valid_instant(report(AUTUMN[2:])).count() == 1
    with pytest.raises(Exception, match="unreadable"):
        vendors.valid_instant(report([("2025-11-02", "noon")])).collect()


def test_system_rows_are_judged_report_by_report(spark):
    df = spark.createDataFrame([(1, "System-Wide"), (1, "NORTH"), (2, "NORTH"), (2, "SOUTH")], "report int, zone string")
    assert sorted(map(tuple, vendors.system_rows(df, ["report"]).select("report", "zone").collect())) == [(1, "System-Wide"), (2, "NORTH"), (2, "SOUTH")]


def test_regions_must_be_known_and_present(spark):
    df = spark.createDataFrame([("R31", 1.0), ("R32", 2.0)], "duoarea string, value double")
    assert jobs.region_rows(df, ["R31"]).count() == 1
    with pytest.raises(ValueError, match="Unknown"):
        jobs.region_rows(df, ["R31", "R99"])
    with pytest.raises(ValueError, match="R33"):
        jobs.region_rows(df, ["R31", "R33"])


def test_every_state_of_a_region_needs_a_location(spark):
    states = spark.createDataFrame([("R31", "A"), ("R31", "B")], "duoarea string, state string")
    located = spark.createDataFrame([("A", 1.0, 0.2), ("B", 3.0, 0.3), ("C", 9.0, 0.5)], "state string, population double, weight double")
    assert {r["state"]: r["weight"] for r in dimensions.regional_locations(located, states).collect()} == {"A": 0.25, "B": 0.75}
    with pytest.raises(Exception, match="No location for state B"):
        dimensions.regional_locations(located.where("state <> 'B'"), states).collect()


def test_every_component_needs_rows(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 3), "X", 1.0), (dt.date(2019, 1, 3), "Y", 1.0)], "period date, series string, value double")
    window = (F.lit("2019-01-01").cast("date"), F.lit("2020-12-31").cast("date"))
    assert payloads.labelled_components(df, {"X": "x", "Y": "y"}, *window).count() == 2
    with pytest.raises(ValueError, match=r"\['z'\]"):
        payloads.labelled_components(df, {"X": "x", "Z": "z"}, *window)
    with pytest.raises(ValueError, match=r"\['y'\]"):
        payloads.labelled_components(df, {"X": "x", "Y": "y"}, F.lit("2020-01-01").cast("date"), window[1])


def test_every_target_date_needs_a_scenario(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [("R31", dt.date(2026, 1, 9), at, 1.0), ("R31", dt.date(2026, 1, 16), at, 2.0), ("R32", dt.date(2026, 1, 9), at, 3.0), ("R31", dt.date(2026, 1, 23), at + dt.timedelta(days=9), 4.0)]
    df = spark.createDataFrame(rows, "duoarea string, date date, issued_at timestamp, hdd double")
    dates = lambda *d: spark.createDataFrame([(dt.date(2026, 1, x),) for x in d], "date date")
    origin = F.lit("2026-01-02").cast("timestamp")
    assert {r["date"].day: r["hdd"] for r in asof.scenario_as_of(df, origin, "R31", dates(9, 16)).collect()} == {9: 1.0, 16: 2.0}
    with pytest.raises(Exception, match="No weather scenario is known at the origin for R31 2026-01-23"):
        asof.scenario_as_of(df, origin, "R31", dates(9, 23)).collect()
    assert asof.scenario_as_of(df, origin, target_dates=dates(9)).count() == 2
    with pytest.raises(Exception, match="R32 2026-01-16"):
        asof.scenario_as_of(df, origin, target_dates=dates(9, 16)).collect()


def test_required_series(spark):
    abbrs = spark.createDataFrame([("AA",)], "abbr string")
    have = [(c,) for c in disaggregate.NATIONAL] + [(f"N30{p}AA2",) for p in (10, 20, 35, 45)]
    disaggregate.require_series(spark.createDataFrame(have, "series string"), abbrs)
    with pytest.raises(ValueError, match="N3045AA2"):
        disaggregate.require_series(spark.createDataFrame(have[:-1], "series string"), abbrs)


def test_system_inputs_as_known_at_the_origin(spark):
    at = dt.datetime(2026, 1, 10)
    origin = F.lit("2026-01-10 00:00:00").cast("timestamp")
    with pytest.raises(ValueError, match="between 1 and 168"):
        jobs.delivery_hours(spark, origin, 169)
    hours = jobs.delivery_hours(spark, origin, 3)
    bare = jobs.system_inputs(hours, origin).orderBy("delivery_hour").collect()
    assert len(bare) == 3 and bare[0]["nuclear_mw"] == 0.0 and bare[0]["available_capacity_mw"] is None and bare[0]["conventional_outage_mw"] == 0.0
    assert "hydro_mw:zero_missing_history" in bare[0]["profile_sources"]
    hour = dt.timedelta(hours=1)
    series = [("nuclear_mw", at - k * hour, 50.0) for k in range(1, 200)] + [("net_imports_mw", at - k * hour, -7.0) for k in range(1, 200)]
    series += [("hydro_mw", at - k * hour, -3.0) for k in range(1, 200)] + [("nuclear_mw", at + k * hour, 9e9) for k in range(5)]
    nonthermal = spark.createDataFrame(series, "series string, valid_at timestamp, actual_mw double")
    table = lambda *rows: spark.createDataFrame([(at + h * hour, i, r, v) for h, i, r, v in rows], "valid_at timestamp, issued_at timestamp, retrieved_at timestamp, v double")
    old, new, late = at - 5 * hour, at - hour, at + hour
    outages = table((1, old, old, 1.0), (1, new, new, 2.0), (1, late, late, 9.0), (2, old, late, 5.0)).withColumnRenamed("v", "conventional_outage_mw")
    adequacy = table((3, new, new, 80.0)).withColumnRenamed("v", "available_capacity_mw")
    rows = jobs.system_inputs(hours, origin, nonthermal, outages, adequacy).orderBy("delivery_hour").collect()
    assert [r["conventional_outage_mw"] for r in rows] == [2.0, 0.0, 0.0] and [r["available_capacity_mw"] for r in rows] == [None, None, 80.0]
    assert {(r["nuclear_mw"], r["net_imports_mw"], r["hydro_mw"], r["battery_net_discharge_mw"]) for r in rows} == {(50.0, -7.0, 0.0, 0.0)}
    assert "battery_net_discharge_mw:zero_missing_history" in rows[0]["profile_sources"] and "nuclear_mw:hour_of_week_adjusted" in rows[0]["profile_sources"]


def test_jobs_publish_what_they_return(spark, tmp_path):
    from pitcast.sources import store

    days = [dt.date(2026, 1, 3) + dt.timedelta(days=i) for i in range(14)]
    states = spark.createDataFrame([(s, "R31", d, 40.0, 25.0, 0.0, w) for d in days for s, w in (("A", 0.25), ("B", 0.75))],
                                   "state string, duoarea string, date date, temperature_f double, hdd double, cdd double, population_weight double")
    target = str(tmp_path / "t")
    built = jobs.weather_job(states, target)
    assert built.count() == 2 and sorted(built.collect()) == sorted(store.read_latest(spark, f"{target}/weather").select(*built.columns).collect())
    origins = spark.createDataFrame([("R31", days[0]), ("R32", days[0])], "duoarea string, date date")
    vintages = spark.createDataFrame([("R31", days[0])], "duoarea string, date date")
    with pytest.raises(ValueError, match="R32"):
        jobs.asof_balance_job(origins, vintages, target=target)
    long = spark.createDataFrame([(dt.date(2018, 1, 5) + dt.timedelta(weeks=w), c, 100.0 + w % 7) for w in range(320) for c in (
        "production_kbpd", "refinery_inputs_kbpd", "imports_kbpd", "exports_kbpd", "commercial_stocks_kb", "spr_stocks_kb")], "period date, component string, value double")
    balance, forecast = jobs.crude_job(long, target)
    assert forecast.count() == 1 and store.read_latest(spark, f"{target}/forecast").count() == 1
    assert store.read_latest(spark, f"{target}/balance").count() == balance.count() and store.read_latest(spark, f"{target}/observations").count() == long.count()


def test_some_weight_must_be_known(spark):
    df = spark.createDataFrame([("A", "R31", dt.datetime(2026, 1, 1), 2.0), ("B", "R31", dt.datetime(2026, 1, 1), 6.0)], "state string, duoarea string, available_at timestamp, load double")
    late, early = (F.lit(x).cast("timestamp") for x in ("2026-01-02", "2025-01-02"))
    assert {r["state"]: r["weather_weight"] for r in asof.state_weights_as_of(df, late, "load").collect()} == {"A": 0.25, "B": 0.75}
    with pytest.raises(ValueError, match="No state weight"):
        asof.state_weights_as_of(df, early, "load")
