"""Calendars, local clocks, payloads, vendor reports and tables on hand-computed frames."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from pitcast.functions import calendar as cal
from pitcast.functions.columns import find_column, require_columns
from pitcast.functions.hashing import frame_hash
from pitcast.operators import rollups
from pitcast.sources import payloads, store, vendors
from pitcast.streaming.vintages import start_intake


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_week_label_is_the_closing_friday(spark):
    df = spark.createDataFrame([("2024-01-06",), ("2024-01-12",), ("2024-01-13",)], "d string")
    out = [r[0].isoformat() for r in df.select(cal.week_ending_friday("d")).collect()]
    assert out == ["2024-01-12", "2024-01-12", "2024-01-19"]


def test_full_weeks_only(spark):
    days = [(dt.date(2024, 1, 6) + dt.timedelta(days=i), 64.0 - i, 1.0, 2.0) for i in range(10)]
    weekly = rollups.weekly_weather(spark.createDataFrame(days, "date date, temperature_f double, hdd double, cdd double"))
    assert rows(weekly.select("date", "hdd", "cdd", "weather_days")) == [(dt.date(2024, 1, 12), 7.0, 14.0, 7)]


@pytest.mark.parametrize("day,hour,expected", [
    ("2026-01-05", "1:00", "2026-01-05 07:00:00"), ("2026-01-05", "24:00", "2026-01-06 06:00:00"),
    ("2026-07-05", "13", "2026-07-05 18:00:00"), ("2026-03-08", "02:00", "2026-03-08 08:00:00"),
])
def test_hour_ending_to_utc(spark, day, hour, expected):
    df = spark.createDataFrame([(day, hour)], "d string, h string")
    out = df.select(cal.local_to_utc(cal.hour_ending_clock("d", "h")).cast("string")).first()[0]
    assert out == expected


def test_repeated_autumn_hour_uses_row_order(spark):
    # 2026-11-01 01:00 occurs twice; the second row in report order is the later instant.
    df = spark.createDataFrame(
        [(i, "2026-11-01", h, 10.0 + i) for i, h in enumerate(["00:00", "01:00", "01:00", "02:00"])],
        "pos int, `Delivery Date` string, hourEnding string, `System Total` double",
    )
    out = vendors.valid_instant(df, order="pos").orderBy("pos").select(F.col("valid_at").cast("string"))
    assert [r[0] for r in out.collect()] == [
        "2026-11-01 05:00:00", "2026-11-01 06:00:00", "2026-11-01 07:00:00", "2026-11-01 08:00:00"
    ]


def test_alias_lookup_and_required_columns(spark):
    df = spark.createDataFrame([(1, 2)], "`Hour Ending` int, STWPF int")
    assert find_column(df, ["he", "hourending"]) == "Hour Ending"
    assert find_column(df, ["x"], required=False) is None
    with pytest.raises(ValueError):
        find_column(df, ["x"])
    with pytest.raises(ValueError, match="missing"):
        require_columns(df, ["gone"])


def test_ensemble_payload_to_weekly_scenario(spark):
    days = [f"2026-01-{d:02d}" for d in range(3, 10)]
    body = lambda a, b: json.dumps({"daily": {"time": days, "temperature_2m_mean": [a] * 7, "temperature_2m_mean_member01": [b] * 7}})
    df = spark.createDataFrame(
        [("A", "R31", body(50.0, 40.0)), ("B", "R31", body(60.0, 45.0))], "state string, duoarea string, payload string"
    ).withColumn("issued_at", F.lit("2026-01-02 00:00:00").cast("timestamp"))
    archive = payloads.ensemble_archive(df)
    assert archive.count() == 28
    assert {r[0] for r in archive.select("ensemble_member").distinct().collect()} == {"control", "member01"}
    weights = spark.createDataFrame([("A", "R31", 0.75), ("B", "R31", 0.25)], "state string, duoarea string, weather_weight double")
    members = rollups.region_members(archive, weights)
    assert members.count() == 14
    scenario = rollups.weekly_scenarios(members).collect()
    assert len(scenario) == 1
    # control: .75*15+.25*5=12.5 per day; member: .75*25+.25*20=23.75; mean of the weekly sums
    assert scenario[0]["hdd"] == pytest.approx((12.5 + 23.75) * 7 / 2)
    assert scenario[0]["ensemble_members"] == 2


def test_partial_first_day_has_partial_coverage(spark):
    body = json.dumps({"daily": {"time": ["2026-01-02", "2026-01-03"], "temperature_2m_mean": [50, 51]}})
    df = spark.createDataFrame([("A", "R31", body)], "state string, duoarea string, payload string")
    out = payloads.ensemble_archive(df.withColumn("issued_at", F.lit("2026-01-02 18:00:00").cast("timestamp")))
    assert [r[0] for r in out.orderBy("valid_start").select("coverage").collect()] == [0.25, 1.0]


def test_fixed_lead_issue_times_and_nulls(spark):
    body = json.dumps({"daily": {"time": ["2026-01-02", "2026-01-03"], "temperature_2m_mean_previous_day2": [50, None]}})
    df = spark.createDataFrame([("A", "R31", body)], "state string, duoarea string, payload string")
    out = payloads.fixed_lead_archive(df).collect()
    assert len(out) == 1 and str(out[0]["issued_at"]) == "2025-12-31 00:00:00"


def test_payload_shape_errors(spark):
    df = spark.createDataFrame([("A", json.dumps({"daily": {"time": ["2026-01-02"], "temperature_2m_mean": [1, 2]}}))], "state string, payload string")
    with pytest.raises(Exception, match="differ in length"):
        payloads.daily_temperatures(df).collect()
    with pytest.raises(Exception, match="response.data"):
        payloads.statistical_rows(spark.createDataFrame([("{}",)], "payload string")).collect()


def test_fielded_rows_in_three_shapes(spark):
    bodies = [
        {"fields": [{"name": "a"}, {"name": "b"}], "data": [["1", "2"]]}, {"data": [{"a": "3", "b": "4"}]}, {"_embedded": {"x": [{"a": "5", "b": "6"}]}},
    ]
    df = spark.createDataFrame([(json.dumps(b),) for b in bodies], "payload string")
    assert rows(payloads.columns_of(payloads.fielded_rows(df), ["a", "b"])) == [("1", "2"), ("3", "4"), ("5", "6")]


def test_component_report_prefers_system_row_and_sums_zones(spark):
    at = F.lit("2026-01-10 00:00:00").cast("timestamp")
    base = [("2026-01-05", "01:00", "2026-01-04T12:00:00", z, v) for z, v in (("NORTH", 3.0), ("SOUTH", 4.0))]
    schema = "`Delivery Date` string, hourEnding string, postedDatetime string, region string, `System Total` double"
    zones = vendors.component_product(spark.createDataFrame(base, schema), "load", at)
    assert [(r["baseline_mw"], r["actual_mw"]) for r in zones.collect()] == [(7.0, None)]
    system = vendors.component_product(spark.createDataFrame(base + [base[0][:3] + ("System-Wide", 9.0)], schema), "load", at)
    assert [r["baseline_mw"] for r in system.collect()] == [9.0]
    with pytest.raises(ValueError):
        vendors.component_product(spark.createDataFrame(base, schema), "tidal", at)


def test_interchange_sign_and_spaces(spark):
    df = spark.createDataFrame(
        [("2026-01-01T00", "ERCO", "Total Interchange", "1250"), ("2026-01-01T00", "ERCO", "Natural Gas", "7"), ("2026-01-01T00", "MISO", "Natural Gas", "9")],
        "period string, respondent string, type_name string, value string",
    ).withColumn("period", F.concat("period", F.lit(":00:00")))
    out = vendors.hourly_actuals(df, ["Total Interchange", "Natural Gas"]).first()
    assert out["net_imports_actual_mw"] == -1250.0 and out["gas_generation_actual_mw"] == 7.0 and out["wind_actual_mw"] is None


@pytest.mark.parametrize("have,expected", [([3, 4, 5], [(1, 2), (6, 7)]), ([1, 2, 5, 7], [(3, 4), (6, 6)]), ([], [(1, 7)])])
def test_date_gaps(spark, have, expected):
    known = spark.createDataFrame([(dt.date(2024, 1, d),) for d in have], "date date")
    out = store.date_gaps(known, F.lit("2024-01-01").cast("date"), F.lit("2024-01-07").cast("date"))
    assert [(a.day, b.day) for a, b in rows(out)] == expected


def test_year_periods_split_long_gaps_only(spark):
    df = spark.createDataFrame(
        [(dt.date(2022, 12, 20), dt.date(2023, 1, 5)), (dt.date(2022, 6, 1), dt.date(2024, 2, 1))], "gap_start date, gap_end date"
    )
    assert rows(store.year_periods(df), "period_start") == [
        (dt.date(2022, 6, 1), dt.date(2022, 12, 31)), (dt.date(2022, 12, 20), dt.date(2023, 1, 5)),
        (dt.date(2023, 1, 1), dt.date(2023, 12, 31)), (dt.date(2024, 1, 1), dt.date(2024, 2, 1)),
    ]


def _batch(spark, value, retrieved="2026-01-02 01:00:00"):
    return spark.createDataFrame(
        [("s", "p1", "load", "2026-01-02 00:00:00", retrieved, "2026-01-03 00:00:00", "g", "h", value)],
        "source string, product_id string, component string, issued_at string, retrieved_at string, valid_at string, geography string, source_hash string, baseline_mw double",
    ).withColumns({c: F.col(c).cast("timestamp") for c in ("issued_at", "retrieved_at", "valid_at")})


def test_vintages_append_and_latest_prefers_new_batch(spark, tmp_path):
    vint, latest = str(tmp_path / "v"), str(tmp_path / "l")
    store.append_and_materialize(_batch(spark, 5.0), vint, latest)
    store.append_and_materialize(_batch(spark, 4.0), vint, latest)
    assert spark.read.parquet(vint).count() == 2
    assert [r["baseline_mw"] for r in store.read_latest(spark, latest).collect()] == [4.0]


def test_vintage_contract_rejections(spark, tmp_path):
    root = str(tmp_path / "v")
    with pytest.raises(ValueError, match="issued_after_retrieved"):
        store.append_vintage(_batch(spark, 1.0, "2026-01-01 00:00:00"), root)
    with pytest.raises(ValueError, match="missing"):
        store.append_vintage(_batch(spark, 1.0).drop("source_hash"), root)
    with pytest.raises(ValueError, match="empty"):
        store.append_vintage(_batch(spark, 1.0).where("false"), root)


def test_missing_table_is_empty(spark, tmp_path):
    assert store.read_table(spark, str(tmp_path / "nothing"), "a int").count() == 0
    assert store.latest_path(spark, str(tmp_path / "nothing")) is None
    with pytest.raises(FileNotFoundError):
        store.read_latest(spark, str(tmp_path / "nothing"))


def test_stream_intake_is_incremental(spark, tmp_path):
    landing, vint, latest, mark = (str(tmp_path / n) for n in "abcd")
    schema = _batch(spark, 1.0).schema
    for value in (1.0, 2.0):
        _batch(spark, value).write.mode("append").parquet(landing)
        start_intake(spark, landing, schema, vint, latest, mark).awaitTermination()
    assert spark.read.parquet(vint).count() == 2
    assert [r["baseline_mw"] for r in store.read_latest(spark, latest).collect()] == [2.0]


def _hours(spark, days, value):
    one = _batch(spark, value).drop("valid_at")
    return one.withColumn("day", F.explode(F.array(*map(F.lit, days)))).withColumn(
        "valid_at", F.explode(F.array(*[F.expr(f"timestamp(day) + INTERVAL '{h}' HOUR") for h in (0, 5, 23)]))
    ).drop("day")


def _files(root):
    return {p: p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_stream_intake_writes_only_the_days_it_touches(spark, tmp_path):
    landing, vint, latest, mark = (str(tmp_path / n) for n in "abcd")
    schema = _hours(spark, ["2026-01-03"], 1.0).schema
    send = lambda *a: (_hours(spark, *a).write.mode("append").parquet(landing), start_intake(spark, landing, schema, vint, latest, mark).awaitTermination())
    send(["2026-01-03", "2026-01-04", "2026-01-05"], 1.0)
    before, folders = _files(tmp_path / "c"), store.latest_days(spark, latest)
    send(["2026-01-04", "2026-01-06"], 2.0)
    after, now = _files(tmp_path / "c"), store.latest_days(spark, latest)
    assert before.items() <= after.items()
    assert {d for d in now if now[d] == folders.get(d)} == {"2026-01-03", "2026-01-05"} and set(now) - set(folders) == {"2026-01-06"}
    assert {p.parent.name for p in set(after) - set(before)} == {"delivery_day=2026-01-04", "delivery_day=2026-01-06"}
    got = sorted((r["valid_at"].isoformat(), r["baseline_mw"]) for r in store.read_latest(spark, latest).collect())
    assert got == [(f"2026-01-{d:02}T{h:02}:00:00", 2.0 if d in (4, 6) else 1.0) for d in (3, 4, 5, 6) for h in (0, 5, 23)]
    assert set(store.read_latest(spark, latest).columns) == set(schema.names)


def test_a_whole_version_becomes_days(spark, tmp_path):
    vint, latest = str(tmp_path / "v"), str(tmp_path / "l")
    store.publish(_hours(spark, ["2026-01-03", "2026-01-04"], 1.0), latest)
    store.append_and_materialize(_hours(spark, ["2026-01-04"], 3.0), vint, latest)
    assert set(store.latest_days(spark, latest)) == {"2026-01-03", "2026-01-04"}
    assert sorted(r["baseline_mw"] for r in store.read_latest(spark, latest).collect()) == [1.0] * 3 + [3.0] * 3


def test_a_batch_is_evaluated_once_and_numbered_batches_replace_theirs(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda v: (seen.add(1), v)[1], "double").asNondeterministic()
    batch = _batch(spark, 5.0).withColumn("baseline_mw", count("baseline_mw"))
    vint, latest = str(tmp_path / "v"), str(tmp_path / "l")
    store.append_and_materialize(batch, vint, latest, 7)
    assert seen.value == 1
    store.append_vintage(_batch(spark, 6.0), vint, batch=7)
    store.append_vintage(_batch(spark, 8.0), vint)
    assert sorted(r["baseline_mw"] for r in spark.read.parquet(vint).collect()) == [6.0, 8.0]


def test_frame_hash_ignores_order_but_not_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    h = lambda df: frame_hash(df).first()["source_hash"]
    assert h(a) == h(a.orderBy(F.desc("a")).repartition(3)) == h(a.select("b", "a"))
    assert h(a) != h(a.where("a = 1")) and h(a) != h(a.fillna("", ["b"])) and h(a) != h(a.union(a.where("a = 1")))


def test_guarded_region(spark):
    df = spark.createDataFrame([("R31",), ("R32",)], "duoarea string")
    with pytest.raises(ValueError):
        store.require_region(df, "R31")
    assert store.require_region(df.where("duoarea = 'R31'"), "R31").count() == 1
