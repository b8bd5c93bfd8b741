"""Sources, sinks, incremental maintenance, vendor reports, jobs and report queries (S, P04-P21, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pitcast.functions.calendar import LOCAL_ZONE
from pitcast.operators import metrics
from pitcast.plans import jobs, reports
from pitcast.plans.fixtures import CRUDE_PARTS
from pitcast.plans.queries_features import FEATURE_CTE, lag
from pitcast.plans.queries_models import _LB, _WKLY, _balance, _crude_forecast, _OIL, b10
from pitcast.plans.queries_rollups import _YW
from pitcast.plans.registry import d, query, r
from pitcast.session import scratch_path
from pitcast.sources import dimensions, payloads, store, vendors
from pitcast.streaming.vintages import start_intake

_WEEK = "(CAST({0} AS DATE) + CAST((12 - isodow({0})) % 7 AS INTEGER))"


@query("s01_parquet_scan", f"SELECT o_orderkey, {r('o_totalprice')} FROM orders WHERE o_orderstatus = 'F'")
def s01(t):
    schema = "o_orderkey bigint, o_totalprice double, o_orderstatus string"
    here = store.read_table(t.spark, f"{t.sf_dir}/orders.parquet", schema)
    absent = store.read_table(t.spark, f"{t.sf_dir}/no_such_table.parquet", schema)
    return here.unionByName(absent).where(F.col("o_orderstatus") == "F").drop("o_orderstatus")


@query("s02_atomic_overwrite", f"SELECT duoarea, {d('date')}, {r('storage_bcf + 1 AS storage_bcf')} FROM wk_storage")
def s02(t):
    root = scratch_path(t.spark, "s02")
    store.publish(t.wk_storage.select("duoarea", "date", "storage_bcf"), root)
    current = store.read_latest(t.spark, root)
    store.publish(current.withColumn("storage_bcf", F.col("storage_bcf") + 1), root)
    return store.read_latest(t.spark, root)


def vintage_batch(t):
    """Power vintages with full provenance."""
    return t.power_vintages.select(
        F.lit("vendor").alias("source"), F.concat(F.lit("P-"), "component").alias("product_id"), "component", "issued_at", "retrieved_at", "valid_at",
        F.lit("ERCOT").alias("geography"), F.sha2(F.concat_ws("|", "component", "issued_at"), 256).alias("source_hash"), "baseline_mw", "actual_mw",
    )


@query("s03_vintage_append", "SELECT 'P-' || component AS product_id, 2 * count(*) AS n FROM power_vintages GROUP BY 1")
def s03(t):
    root, batch = scratch_path(t.spark, "s03"), vintage_batch(t)
    store.append_vintage(batch, root)
    store.append_vintage(batch, root)
    return t.spark.read.parquet(root).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


@query("s04_versioned_save", f"SELECT duoarea, {d('date')}, {r('storage_bcf')} FROM wk_storage")
def s04(t):
    root = scratch_path(t.spark, "s04")
    store.publish(t.wk_storage.select("duoarea", "date", "storage_bcf"), root, ["duoarea"])
    return store.read_latest(t.spark, root)


_UP = "SELECT coalesce(n.duoarea, o.duoarea) AS duoarea, CAST(coalesce(n.date, o.date) AS TIMESTAMP) AS date, {v} FROM (SELECT * FROM wk_storage WHERE year <= 1999) o FULL JOIN (SELECT * FROM wk_storage WHERE year >= 1999) n ON o.duoarea = n.duoarea AND o.date = n.date"


@query("s05_timeseries_merge", _UP.format(v=r("coalesce(n.storage_bcf + 0.5, o.storage_bcf) AS storage_bcf")))
def s05(t):
    cols = t.wk_storage.select("duoarea", "date", "storage_bcf", "year")
    new = cols.where(F.col("year") >= 1999).withColumn("storage_bcf", F.col("storage_bcf") + 0.5)
    return store.upsert(cols.where(F.col("year") <= 1999), new, ["duoarea", "date"]).drop("year")


_GAPS = """SELECT state, lo AS gap_start, hi AS gap_end FROM (SELECT state, min(dd) AS lo, max(dd) AS hi FROM (SELECT state, dd, dd - CAST(row_number() OVER (PARTITION BY state ORDER BY dd) AS INTEGER) AS grp FROM (
  SELECT state, CAST(unnest(generate_series(DATE '1996-03-01', DATE '1997-09-30', INTERVAL 1 DAY)) AS DATE) AS dd FROM (SELECT DISTINCT state FROM state_daily) EXCEPT SELECT state, date FROM state_daily)) GROUP BY state, grp)"""


@query("s06_gap_detection", f"SELECT state, {d('gap_start', 'gap_end')} FROM ({_GAPS})")
def s06(t):
    return store.date_gaps(t.state_daily, F.lit("1996-03-01").cast("date"), F.lit("1997-09-30").cast("date"), ["state"])


@query("s07_period_split", f"""SELECT state, CAST(CASE WHEN gap_end - gap_start + 1 <= 3 THEN gap_start ELSE greatest(gap_start, make_date(y, 1, 1)) END AS TIMESTAMP) AS period_start, CAST(CASE WHEN gap_end - gap_start + 1 <= 3 THEN gap_end ELSE least(gap_end, make_date(y, 12, 31)) END AS TIMESTAMP) AS period_end
  FROM (SELECT *, unnest(CASE WHEN gap_end - gap_start + 1 <= 3 THEN [year(gap_start)] ELSE range(year(gap_start), year(gap_end) + 1) END) AS y FROM ({_GAPS}))""")
def s07(t):
    return store.year_periods(s06(t), 3)


@query("s08_revision_tail", "SELECT duoarea, CAST(date AS TIMESTAMP) AS period, " + r("storage_bcf + CASE WHEN date >= (SELECT max(date) FROM wk_storage WHERE year <= 1999) - 56 THEN 2.0 ELSE 0.0 END AS value") + " FROM wk_storage")
def s08(t):
    landed = t.storage_raw.withColumn("value", F.col("value") + 2.0)
    existing = t.storage_raw.where(F.year("period") <= 1999)
    return store.refresh_tail(existing, landed, ["duoarea", "period", "series"], "period", 56, F.lit("1990-01-01").cast("date")).drop("series")


@query("s09_hourly_overlap", f"SELECT component, valid_at, {r("mw + CASE WHEN valid_at >= (SELECT max(valid_at) FROM hours WHERE valid_at <= TIMESTAMP '2024-01-15 00:00:00') - INTERVAL 48 HOUR THEN 1.0 ELSE 0.0 END AS mw")} FROM hours")
def s09(t):
    at = F.lit("2024-01-15 00:00:00").cast("timestamp")
    existing = t.hours.where(F.col("valid_at") <= at)
    return store.refresh_hours(existing, t.hours.withColumn("mw", F.col("mw") + 1.0), at, ["component", "valid_at"])


@query("s10_append_and_materialize", f"SELECT component, issued_at, valid_at, {r('baseline_mw + 1 AS baseline_mw')} FROM power_vintages")
def s10(t):
    batch = vintage_batch(t)
    vint, latest = scratch_path(t.spark, "s10v"), scratch_path(t.spark, "s10l")
    store.append_and_materialize(batch, vint, latest)
    later = batch.withColumn("baseline_mw", F.col("baseline_mw") + 1)
    store.append_and_materialize(later, vint, latest)
    return store.read_latest(t.spark, latest).select("component", "issued_at", "valid_at", "baseline_mw")


@query("s10_streaming_intake", f"SELECT component, issued_at, valid_at, {r('baseline_mw')} FROM power_vintages")
def s10_stream(t):
    """The same step driven by a file stream that drains the landed parts."""
    landing, vint, latest, mark = (scratch_path(t.spark, f"s10s{i}") for i in range(4))
    batch = vintage_batch(t)
    batch.write.parquet(landing)
    start_intake(t.spark, landing, batch.schema, vint, latest, mark).awaitTermination()
    return store.read_latest(t.spark, latest).select("component", "issued_at", "valid_at", "baseline_mw")


@query("s11_recover_actuals", f"""SELECT coalesce(e.entity, v.entity) AS entity, coalesce(e.valid_at, v.valid_at) AS valid_at, {r('coalesce(e.value + 1, v.value) AS value')} FROM (SELECT entity, valid_at, value FROM vintages QUALIFY row_number() OVER (PARTITION BY entity, valid_at ORDER BY issued_at DESC, retrieved_at DESC, value DESC) = 1) v
  FULL JOIN (SELECT entity, valid_at, max(value) AS value FROM vintages WHERE valid_at < TIMESTAMP '1997-01-01' GROUP BY 1, 2) e USING (entity, valid_at)""")
def s11(t):
    existing = t.versions.where(F.col("valid_at") < "1997-01-01").groupBy("entity", "valid_at").agg((F.max("value") + 1).alias("value"))
    return store.recover_actuals(t.versions, existing, ["entity", "valid_at"])


def _stat_payloads(t):
    """One landed response per region and year."""
    rows = t.storage_raw.select("duoarea", F.year("period").alias("y"), F.struct(F.date_format("period", "yyyy-MM-dd").alias("period"), "series", "duoarea", F.col("value").cast("string").alias("value")).alias("s"))
    packed = rows.groupBy("duoarea", "y").agg(F.collect_list("s").alias("data"))
    return packed.select(F.to_json(F.struct(F.struct("data").alias("response"))).alias("payload"))


@query("s12_statistical_json", f"SELECT duoarea, {d('period')}, series, {r('value')} FROM storage_raw")
def s12(t):
    return payloads.statistical_rows(_stat_payloads(t))


@query("s12_labelled_components", f"SELECT {d('period')}, component, {r('value')} FROM crude_long WHERE period BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def s12_components(t):
    rows = t.crude_long.withColumn("series", F.concat(F.lit("W_"), F.upper("component"))).drop("component")
    names = {f"W_{c.upper()}": c for c in CRUDE_PARTS}
    return payloads.labelled_components(rows, names, F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date"))


def _daily_payloads(t, fields):
    """One landed daily response per state; ``fields`` maps variable name to expression."""
    ordered = t.state_daily.select("state", "duoarea", F.struct(F.date_format("date", "yyyy-MM-dd").alias("time"), *[v.cast("string").alias(k) for k, v in fields.items()]).alias("s"))
    packed = ordered.groupBy("state", "duoarea").agg(F.array_sort(F.collect_list("s")).alias("a"))
    daily = F.struct(*[F.col(f"a.{k}").alias(k) for k in ("time", *fields)])
    return packed.select("state", "duoarea", F.to_json(F.struct(daily.alias("daily")), {"ignoreNullFields": "false"}).alias("payload"))


@query("s13_daily_array_json", f"SELECT state, {d('date')}, {r('temperature_f')} FROM state_daily")
def s13(t):
    return payloads.daily_temperatures(_daily_payloads(t, {"temperature_2m_mean": F.col("temperature_f")}))


@query("s14_ensemble_json", f"""SELECT state, duoarea, ensemble_member, CAST(date AS TIMESTAMP) AS valid_start, {r('temperature_f + off AS temperature_f', 'greatest(0.0, 65.0 - temperature_f - off) AS hdd', "least(greatest((epoch(CAST(date AS TIMESTAMP) + INTERVAL 1 DAY) - epoch(greatest(CAST(date AS TIMESTAMP), TIMESTAMP '1998-01-01 06:00:00')))/86400.0, 0.0), 1.0) AS coverage")}
  FROM state_daily, (VALUES ('control', 0.0), ('member01', 1.0), ('member02', 2.0)) m(ensemble_member, off)""")
def s14(t):
    x = F.col("temperature_f")
    df = _daily_payloads(t, {"temperature_2m_mean": x, "temperature_2m_mean_member01": x + 1, "temperature_2m_mean_member02": x + 2})
    out = payloads.ensemble_archive(df.withColumn("issued_at", F.lit("1998-01-01 06:00:00").cast("timestamp")))
    return out.select("state", "duoarea", "ensemble_member", "valid_start", "temperature_f", "hdd", "coverage")


@query("s15_fixed_lead_json", f"SELECT state, duoarea, CAST(date AS TIMESTAMP) - to_days(CAST(k AS INTEGER)) AS issued_at, CAST(date AS TIMESTAMP) AS valid_start, {r('temperature_f + k AS temperature_f')} FROM state_daily, range(0, 3) x(k) WHERE k <> 1 OR day(date) % 2 = 0")
def s15(t):
    x = F.col("temperature_f")
    df = _daily_payloads(t, {"temperature_2m_mean_previous_day0": x, "temperature_2m_mean_previous_day1": F.when(F.day("date") % 2 == 0, x + 1), "temperature_2m_mean_previous_day2": x + 2})
    return payloads.fixed_lead_archive(df).select("state", "duoarea", "issued_at", "valid_start", "temperature_f")


@query("s16_fielded_rows_json", f"SELECT component, valid_at, {r('mw')} FROM hours")
def s16(t):
    row = F.array(F.col("component"), F.date_format("valid_at", "yyyy-MM-dd HH:mm:ss"), F.col("mw").cast("string"))
    packed = t.hours.groupBy("component", F.to_date("valid_at").alias("day")).agg(F.collect_list(row).alias("data"))
    names = F.array(*[F.struct(F.lit(n).alias("name")) for n in ("component", "valid_at", "mw")])
    df = packed.select(F.to_json(F.struct(names.alias("fields"), "data")).alias("payload"))
    rows = payloads.columns_of(payloads.fielded_rows(df), ["component", "valid_at", "mw"])
    return rows.select("component", F.col("valid_at").cast("timestamp").alias("valid_at"), F.col("mw").cast("double").alias("mw"))


@query("s17_weighted_points", f"SELECT valid_at, {r("sum(mw * CASE component WHEN 'load' THEN 0.27 WHEN 'wind' THEN 0.25 WHEN 'solar' THEN 0.18 WHEN 'gas' THEN 0.16 WHEN 'coal' THEN 0.08 END) AS mw")} FROM hours GROUP BY 1")
def s17(t):
    weights = t.spark.createDataFrame([(c, w) for c, (_, _, w) in zip(("load", "wind", "solar", "gas", "coal"), payloads.WEATHER_POINTS)], "component string, weight double")
    return payloads.blend_points(t.hours, weights, ["mw"], "component")


@query("s18_population_locations", f"SELECT state, {r('population', 'population / sum(population) OVER () AS weight')} FROM nations WHERE state <> 'NATION_3'")
def s18(t):
    excluded = t.nations.where(F.col("state") == "NATION_3").select("state")
    return dimensions.population_locations(t.nations.select("state", "population"), excluded)


@query("s19_chunk_merge", f"SELECT state, {d('date')}, {r('temperature_f')} FROM state_daily")
def s19(t):
    chunks, target = scratch_path(t.spark, "s19c"), scratch_path(t.spark, "s19t")
    rows = t.state_daily.select("state", "date", "temperature_f")
    for part in (rows.where(F.year("date") <= 1998), rows.where(F.year("date") >= 1998)):
        part.write.mode("append").parquet(chunks)
    store.merge_chunks(t.spark, chunks, rows.schema, target)
    return t.spark.read.schema(rows.schema).parquet(target)


@query("s20_guarded_region", f"SELECT duoarea, {d('date')}, {r('storage_bcf')} FROM wk_storage WHERE duoarea = 'R34'")
def s20(t):
    return store.require_region(t.wk_storage.where(F.col("duoarea") == "R34").select("duoarea", "date", "storage_bcf"), "R34")


@query("s21_region_dimension", """SELECT r.label, r.slug, count(*) AS weeks FROM wk_all JOIN (VALUES ('R48','lower48','Lower 48 States'),('R31','east','East'),('R32','midwest','Midwest'),('R33','south_central','South Central'),('R34','mountain','Mountain'),('R35','pacific','Pacific')) r(duoarea, slug, label) USING (duoarea) GROUP BY 1, 2""")
def s21(t):
    return t.wk_all.join(dimensions.region_dimension(t.spark), "duoarea").groupBy("label", "slug").agg(F.count(F.lit(1)).alias("weeks"))


@query("s22_series_dimension", """SELECT abbr, component, count(*) AS n FROM (SELECT CASE WHEN series LIKE 'NA1160_S%' THEN regexp_extract(series, '_S([A-Z]{2})_', 1) ELSE substring(series, 6, 2) END AS abbr,
  CASE substring(series, 1, 5) WHEN 'N3010' THEN 'res' WHEN 'N3020' THEN 'com' WHEN 'N3035' THEN 'ind' WHEN 'N3045' THEN 'power_burn' WHEN 'N3050' THEN 'price' WHEN 'N9050' THEN 'marketed_production' WHEN 'NA116' THEN 'dry_production' END AS component FROM monthly_series) WHERE component IS NOT NULL AND abbr <> 'US' GROUP BY 1, 2""")
def s22(t):
    from pitcast.operators.disaggregate import component_of, state_of

    s = F.col("series")
    rows = t.monthly_series.select(state_of(s).alias("abbr"), component_of(s).alias("component"))
    return rows.where(F.col("component").isNotNull() & (F.col("abbr") != "US")).groupBy("abbr", "component").agg(F.count(F.lit(1)).alias("n"))


@query("s25_latest_price", f"SELECT {r('coalesce(last(value ORDER BY period), 3.0) AS gas_price')} FROM daily_price")
def s25(t):
    return payloads.latest_price(t.daily_price)


@query("s26_location_stamp", f"SELECT state, {d('date')}, {r('temperature_f', 'population', 'population / 325.0 AS population_weight')} FROM state_daily WHERE date >= DATE '1997-01-01'")
def s26(t):
    located = dimensions.population_locations(t.nations.select("state", "population"))
    rows = t.state_daily.select("state", "date", "temperature_f").where(F.col("date") >= "1997-01-01")
    return dimensions.stamp_locations(rows, located)


@query("s27_daily_spot_price", f"SELECT {d('period')}, {r('value')} FROM daily_price")
def s27(t):
    rows = t.daily_price.select(F.struct(F.date_format("period", "yyyy-MM-dd").alias("period"), F.lit("RNGWHHD").alias("series"), F.lit(None).cast("string").alias("duoarea"), F.col("value").cast("string").alias("value")).alias("s"), F.trunc("period", "year").alias("y"))
    df = rows.groupBy("y").agg(F.collect_list("s").alias("data")).select(F.to_json(F.struct(F.struct("data").alias("response"))).alias("payload"))
    return payloads.spot_prices(payloads.statistical_rows(df))


def _local(c: str):
    return F.from_utc_timestamp(F.col(c), LOCAL_ZONE)


def _reports(t):
    """Vendor-style reports of every component: local delivery day, hour ending, local posting time, two zones, row order."""
    v = t.power_vintages.where(F.col("actual_mw").isNotNull())
    end = _local("valid_at")
    return v.select(
        "component",
        F.date_format(end - F.expr("INTERVAL 1 SECOND"), "yyyy-MM-dd").alias("Delivery Date"),
        F.concat(F.lpad((F.hour(end - F.expr("INTERVAL 1 SECOND")) + 1).cast("string"), 2, "0"), F.lit(":00")).alias("hourEnding"),
        F.date_format(_local("issued_at"), "yyyy-MM-dd'T'HH:mm:ss").alias("postedDatetime"), F.unix_timestamp("valid_at").alias("line"), "baseline_mw", "actual_mw",
        F.explode(F.array(F.lit("NORTH"), F.lit("SOUTH"))).alias("zone"),
    )


#: Columns that tell one report from another.
_ONE = ["component", "postedDatetime"]


def _report(t, component: str):
    return _reports(t).where(F.col("component") == component).drop("component")


def _per_component(t, read):
    """``read(rows, component)`` of each component's reports, with the component."""
    parts = [read(_report(t, c), c).withColumn("component", F.lit(c)) for c in ("load", "wind", "solar")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _far():
    return F.lit("2025-01-01 00:00:00").cast("timestamp")


@query("p04_local_time_parse", "SELECT component, valid_at, count(*) AS n FROM hours GROUP BY 1, 2")
def p04(t):
    text = F.date_format(_local("valid_at"), "yyyy-MM-dd'T'HH:mm:ss")
    return t.hours.select("component", vendors.vendor_instant(text).alias("valid_at")).groupBy("component", "valid_at").agg(F.count(F.lit(1)).alias("n"))


@query("p05_hour_ending", "SELECT component, valid_at, 2 * count(*) AS n FROM power_vintages WHERE actual_mw IS NOT NULL GROUP BY 1, 2")
def p05(t):
    return vendors.valid_instant(_reports(t), "line", _ONE).groupBy("component", "valid_at").agg(F.count(F.lit(1)).alias("n"))


@query("p06_valid_and_issue_times", "SELECT component, issued_at, count(DISTINCT valid_at) AS hours FROM power_vintages WHERE actual_mw IS NOT NULL GROUP BY 1, 2")
def p06(t):
    rows = vendors.valid_instant(_reports(t), "line", _ONE)
    return rows.withColumn("issued_at", vendors.issue_instant(rows, None)).groupBy("component", "issued_at").agg(F.countDistinct("valid_at").alias("hours"))


@query("p07_system_rows", "SELECT component, count(*) * (CASE WHEN component = 'solar' THEN 2 ELSE 1 END) AS n FROM power_vintages WHERE actual_mw IS NOT NULL GROUP BY 1")
def p07(t):
    """The solar reports name no system row, so all their rows stay."""
    zones = F.when((F.col("zone") == "NORTH") & (F.col("component") != "solar"), F.lit("System-Wide")).otherwise(F.col("zone"))
    return vendors.system_rows(_reports(t).withColumn("zone", zones), _ONE).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


_HALVES = {"load": ("System Total", "Actual Load"), "wind": ("STWPF", "GEN"), "solar": ("STPPF", "GEN")}


@query("p18_component_product", f"SELECT component, issued_at, valid_at, CASE component WHEN 'load' THEN 'NP3-560-CD' WHEN 'wind' THEN 'NP4-732-CD' ELSE 'NP4-745-CD' END AS product_id, {r('baseline_mw', 'actual_mw')} FROM power_vintages WHERE actual_mw IS NOT NULL")
def p18(t):
    def read(rows, c):
        base, real = _HALVES[c]
        named = rows.withColumns({"_b": F.col("baseline_mw") / 2, "_a": F.col("actual_mw") / 2}).drop("baseline_mw", "actual_mw")
        return vendors.component_product(named.withColumnsRenamed({"_b": base, "_a": real}), c, _far(), order="line", report=["postedDatetime"]).drop("component")

    return _per_component(t, read).select("component", "issued_at", "valid_at", "product_id", "baseline_mw", "actual_mw")


@query("p19_actual_load", f"SELECT issued_at, valid_at, {r('actual_mw AS load_actual_mw')} FROM power_vintages WHERE component = 'load' AND actual_mw IS NOT NULL")
def p19(t):
    zones = F.when(F.col("zone") == "NORTH", F.lit("TOTAL")).otherwise(F.col("zone"))
    rows = _report(t, "load").withColumn("zone", zones).withColumnRenamed("actual_mw", "System Load").drop("baseline_mw")
    return vendors.actual_load(rows, _far(), order="line", report=["postedDatetime"]).select("issued_at", "valid_at", "load_actual_mw")


@query("p20_outages", f"SELECT component, issued_at, valid_at, {r('baseline_mw * 4 + 2 * actual_mw AS conventional_outage_mw', '2 * baseline_mw AS renewable_outage_mw', '0.0 AS new_equipment_outage_mw')} FROM power_vintages WHERE actual_mw IS NOT NULL")
def p20(t):
    """The columns of both places are added across the row, and the places to each other."""
    def read(rows, c):
        zones = {"TotalResourceMWZoneSouth": F.col("baseline_mw") * 2, "TotalResourceMWZoneNorth": F.col("actual_mw"), "TotalIRRMWZoneWest": F.col("baseline_mw")}
        return vendors.outages(rows.withColumns(zones).drop("baseline_mw", "actual_mw"), _far(), order="line", report=["postedDatetime"])

    return _per_component(t, read).select("component", "issued_at", "valid_at", "conventional_outage_mw", "renewable_outage_mw", "new_equipment_outage_mw")


@query("p20_adequacy", f"SELECT component, issued_at, valid_at, {r('2 * baseline_mw AS available_capacity_mw')} FROM power_vintages WHERE actual_mw IS NOT NULL")
def p20_adequacy(t):
    def read(rows, c):
        return vendors.adequacy(rows.withColumnRenamed("baseline_mw", "availCapGen").drop("actual_mw"), _far(), order="line", report=["postedDatetime"])

    return _per_component(t, read).select("component", "issued_at", "valid_at", "available_capacity_mw")


@query("p21_weather_forecasts", f"SELECT component, issued_at, valid_at, {r('baseline_mw AS temperature_f', '0.0 AS cloud_cover_pct')} FROM power_vintages")
def p21(t):
    def read(c):
        v = t.power_vintages.where(F.col("component") == c)
        rows = v.select(F.col("valid_at").cast("string").alias("time"), F.col("issued_at").cast("string").alias("run_time"), F.col("baseline_mw").alias("temperature_2m"))
        return vendors.weather_forecasts(rows).withColumn("component", F.lit(c))

    return read("load").unionByName(read("wind")).unionByName(read("solar")).select("component", "issued_at", "valid_at", "temperature_f", "cloud_cover_pct")


@query("a08_hourly_actuals_pivot", f"SELECT valid_at, {r("sum(mw) FILTER (component = 'load') AS load_actual_mw", "sum(mw) FILTER (component = 'gas') AS gas_generation_actual_mw", "- sum(mw) FILTER (component = 'coal') AS net_imports_actual_mw")} FROM hours WHERE component IN ('load', 'gas', 'coal') GROUP BY 1")
def a08_actuals(t):
    label = F.when(F.col("component") == "load", "Demand").when(F.col("component") == "gas", "Natural Gas").when(F.col("component") == "coal", "Total Interchange")
    rows = t.hours.where(label.isNotNull()).select(F.col("valid_at").cast("string").alias("period"), F.lit("ERCO").alias("respondent"), label.alias("type_name"), F.col("mw").cast("string").alias("value"))
    out = vendors.hourly_actuals(rows, ["Demand", "Natural Gas", "Total Interchange"])
    return out.select("valid_at", "load_actual_mw", "gas_generation_actual_mw", "net_imports_actual_mw")


@query("u04_priority_union", f"""SELECT coalesce(l.valid_at, a.valid_at) AS valid_at, {r('coalesce(l.mw, a.mw) AS load_actual_mw')} FROM (SELECT valid_at, last(actual_mw ORDER BY issued_at) AS mw FROM power_vintages WHERE component = 'load' GROUP BY 1) l
  FULL JOIN (SELECT valid_at, mw FROM hours WHERE component = 'wind') a USING (valid_at)""")
def u04(t):
    actuals = t.hours.where(F.col("component") == "wind").select("valid_at", F.col("mw").alias("load_actual_mw"))
    load = t.power_vintages.where(F.col("component") == "load").select("valid_at", "issued_at", F.col("actual_mw").alias("load_actual_mw"))
    return vendors.override_load(actuals, load)


_ST = f"""SELECT duoarea, {d('date')}, {r('storage_bcf', f"storage_bcf - {lag('storage_bcf', 1)} AS weekly_change_bcf")}, year, month, week_of_year FROM wk_storage QUALIFY {lag('storage_bcf', 1)} IS NOT NULL"""


@query("e01_storage_job", _ST)
def e01(t):
    root = scratch_path(t.spark, "e01")
    store.publish(jobs.storage_table(payloads.statistical_rows(_stat_payloads(t))), root, ["duoarea"])
    return store.read_latest(t.spark, root)


_SW = f"""SELECT duoarea, {_WEEK.format('date')} AS date, avg(t) AS temperature_f, sum(h) AS hdd, sum(c) AS cdd, CAST(count(*) AS INTEGER) AS weather_days FROM (SELECT duoarea, date, sum(temperature_f*population_weight) AS t, sum(hdd*population_weight) AS h, sum(cdd*population_weight) AS c FROM state_daily GROUP BY 1, 2) GROUP BY 1, 2"""


@query("e02_weather_job", f"SELECT duoarea, {d('date')}, {r('temperature_f', 'hdd', 'cdd')}, weather_days, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week_of_year FROM ({_SW}) WHERE weather_days = 7")
def e02(t):
    return jobs.weather_job(t.state_daily, scratch_path(t.spark, "e02"))


_E03 = FEATURE_CTE.replace("wk_weather w", f"({_SW}) w")


@query("e03_features_job", f"WITH {_E03} SELECT duoarea, {d('date')}, {r('hdd/weather_days AS hdd_per_day', f"{lag('hdd', 1)} AS hdd_lag1", f"{lag('storage_bcf', 1)} - {lag('storage_bcf', 53)} AS storage_vs_last_year")} FROM avg5")
def e03(t):
    table = jobs.features_job(t.wk_storage, jobs.weather_table(t.state_daily, drop_incomplete=False), scratch_path(t.spark, "e03"))
    return table.select("duoarea", "date", "hdd_per_day", "hdd_lag1", "storage_vs_last_year")


@query("e04_all_regions_job", f"""SELECT duoarea, (SELECT count(*) FROM ({_SW}) w WHERE w.duoarea = s.duoarea) AS weather_weeks, count(*) - 1 AS storage_weeks,
  (SELECT count(*) FROM ({_ST}) x JOIN ({_SW}) w ON w.duoarea = x.duoarea AND w.date = x.date WHERE x.duoarea = s.duoarea) AS feature_weeks FROM wk_storage s GROUP BY 1""")
def e04(t):
    built = jobs.data_job(t.storage_raw, t.state_daily)
    n = lambda name: built[name].groupBy("duoarea").agg(F.count(F.lit(1)).alias(f"{name.removesuffix('s')}_weeks"))
    return n("weather").join(n("storage"), "duoarea").join(n("features"), "duoarea")


@query("e10_power_data_job", f"SELECT component, issued_at, valid_at, {r('baseline_mw', 'actual_mw')} FROM power_vintages WHERE component IN ('wind', 'solar') AND actual_mw IS NOT NULL")
def e10(t):
    vint, latest = scratch_path(t.spark, "e10v"), scratch_path(t.spark, "e10l")
    for c, (base, real) in {"wind": ("STWPF", "GEN"), "solar": ("STPPF", "GEN")}.items():
        rows = _report(t, c).withColumns({base: F.col("baseline_mw") / 2, real: F.col("actual_mw") / 2}).drop("baseline_mw", "actual_mw")
        store.append_and_materialize(vendors.component_product(rows, c, _far(), order="line", report=["postedDatetime"]), vint, latest)
    return store.read_latest(t.spark, latest).select("component", "issued_at", "valid_at", "baseline_mw", "actual_mw")


@query("e14_weekly_report", f"""{_WKLY}, b AS (SELECT fin.*, storage_bcf, weekly_change_bcf, {_LB} AS lb FROM fin JOIN wk_storage s ON s.duoarea = fin.duoarea AND s.date = fin.date)
  SELECT duoarea, {d('date')}, {r('storage_bcf', 'weekly_change_bcf', 'lb AS local_balance', 'weekly_change_bcf - lb AS net_inflow_balancing', 'price', 'price - lag(price) OVER w AS price_delta', 'weekly_change_bcf - lag(weekly_change_bcf) OVER w AS change_delta')} FROM b WINDOW w AS (PARTITION BY duoarea ORDER BY b.date)""")
def e14_weekly(t):
    return reports.weekly_report(_balance(t)).select("duoarea", "date", "storage_bcf", "weekly_change_bcf", "local_balance", "net_inflow_balancing", "price", "price_delta", "change_delta")


@query("e14_outlier_weeks", f"""SELECT s.duoarea, {d('s.date')}, {r('weekly_change_bcf', 'weekly_change_bcf - avg_value AS deviation')}, (weekly_change_bcf < min_value OR weekly_change_bcf > max_value) AS outside_5yr_range FROM wk_storage s JOIN {_YW} p ON p.duoarea = s.duoarea AND p.week_of_year = s.week_of_year WHERE s.year = (SELECT max(year) FROM wk_storage)""")
def e14_outliers(t):
    return reports.outlier_weeks(t.wk_storage)


@query("e14_crude_coverage", f"""{_OIL}, q AS (SELECT b.date, any_value(b.pred) AS p, any_value(b.y) AS y, count(c.date) AS n, list_sort(list(abs(c.y - c.pred)) FILTER (c.date IS NOT NULL)) AS e FROM bt b LEFT JOIN bt c ON c.date <= b.origin AND c.origin < b.origin GROUP BY 1),
  k AS (SELECT *, e[CAST(least(n, ceil((n + 1) * 0.8)) AS INTEGER)] AS radius FROM q WHERE n >= 30) SELECT count(*) AS interval_rows, {r('avg(CAST(abs(y - p) <= radius AS DOUBLE)) AS coverage', 'avg(2 * radius) AS average_width')} FROM k""")
def e14_coverage(t):
    return reports.coverage_card(b10(t), "actual_mmbbl", "lower_bound_mmbbl", "upper_bound_mmbbl")


@query("e14_crude_waterfall", f"""WITH {_crude_forecast('SELECT max(date) + 7 AS target FROM crude_balance')} SELECT CAST(target AS TIMESTAMP) AS date, component AS term, {r("CASE WHEN component IN ('refinery_inputs_mmbbl','exports_mmbbl','spr_stock_change_mmbbl') THEN -f ELSE f END AS value")} FROM cn""")
def e14_waterfall(t):
    return reports.waterfall(jobs.crude_job(t.crude_long)[1])


@query("e14_staleness", "SELECT duoarea, CAST(max(date) AS TIMESTAMP) AS newest, CAST(DATE '2002-01-01' - max(date) AS INTEGER) AS age_days FROM wk_storage GROUP BY 1")
def e14_staleness(t):
    return reports.staleness(t.wk_storage, "date", F.lit("2002-01-01").cast("date"), ["duoarea"])


@query("e14_provenance", "SELECT component, issued_at, 'P-' || component AS product_id, count(*) AS n_rows, min(valid_at) AS first_valid, max(valid_at) AS last_valid FROM power_vintages GROUP BY 1, 2")
def e14_provenance(t):
    return reports.provenance(vintage_batch(t), ["component", "issued_at", "product_id"])


@query("e15_chart_frame", f"""WITH p AS (SELECT duoarea, week_of_year, avg(weekly_change_bcf) AS m, stddev_samp(weekly_change_bcf) AS s FROM wk_storage WHERE year < 2001 GROUP BY 1, 2), q AS (SELECT *, coalesce(s, avg(s) OVER (PARTITION BY duoarea)) AS sd FROM p)
  SELECT w.duoarea, {d('w.date')}, {r('weekly_change_bcf', 'm AS predicted_weekly_change', 'm - sd AS lower_band', 'm + sd AS upper_band', 'weekly_change_bcf - m AS forecast_deviation')}, (weekly_change_bcf > m + sd OR weekly_change_bcf < m - sd) AS outside_band FROM wk_storage w JOIN q ON q.duoarea = w.duoarea AND q.week_of_year = w.week_of_year WHERE year = 2001""")
def e15(t):
    rows = jobs.same_week_average(t.wk_storage.where(F.col("year") < 2001), t.wk_storage.where(F.col("year") == 2001))
    return reports.chart_frame(jobs.deviation_columns(rows))


@query("m08_same_week_average", f"""WITH p AS (SELECT duoarea, week_of_year, avg(weekly_change_bcf) AS m FROM wk_storage WHERE year < 2001 GROUP BY 1, 2) SELECT w.duoarea, {r('avg(abs(weekly_change_bcf - m)) AS mae', 'sqrt(avg((weekly_change_bcf - m)*(weekly_change_bcf - m))) AS rmse', 'avg(weekly_change_bcf - m) AS bias')}
  FROM wk_storage w JOIN p ON p.duoarea = w.duoarea AND p.week_of_year = w.week_of_year WHERE year = 2001 GROUP BY 1""")
def m08(t):
    rows = jobs.same_week_average(t.wk_storage.where(F.col("year") < 2001), t.wk_storage.where(F.col("year") == 2001))
    return metrics.error_metrics(rows, "weekly_change_bcf", "predicted_weekly_change", ["duoarea"])
