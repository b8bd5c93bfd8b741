"""Energy-style tables derived from the driver's star schema, for both engines.

``Tables`` builds each table with DataFrame operations; ``CTES`` states the same table in SQL for the
independent check. Divisors are primes so that rounding never meets a decimal tie.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pitcast.functions.calendar import degree_days, week_ending_friday
from pitcast.operators import reconcile, rollups
from pitcast.session import staged

COMPONENT_OF_EVENT = {"view": "load", "click": "wind", "signup": "solar", "purchase": "gas", "error": "coal"}
CRUDE_PARTS = ("production_kbpd", "refinery_inputs_kbpd", "imports_kbpd", "exports_kbpd", "commercial_stocks_kb", "spr_stocks_kb")


def _area(key: str):
    return F.concat(F.lit("R3"), (F.col(key) + 1).cast("string"))


class Tables:
    """Lazy access to the driver's tables and the tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        casts = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
        return df.withColumns(casts) if casts else df

    @cached_property
    def suppliers(self) -> DataFrame:
        return self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("state"), F.col("n_nationkey").alias("nation"),
            _area("n_regionkey").alias("duoarea"),
        )

    @cached_property
    def shipped(self) -> DataFrame:
        return self.raw("lineitem").join(self.suppliers, "l_suppkey")

    @cached_property
    def wk_flow(self) -> DataFrame:
        q = F.col("l_quantity")
        flag = lambda f, s=None: F.sum(F.when((F.col("l_returnflag") == f) & ((F.col("l_linestatus") == s) if s else F.lit(True)), q).otherwise(0.0))
        return self.shipped.groupBy("duoarea", week_ending_friday("l_shipdate").alias("date")).agg(
            flag("A").alias("a_qty"), flag("R").alias("r_qty"), flag("N", "O").alias("no_qty"), flag("N", "F").alias("nf_qty"),
        )

    @staticmethod
    def _storage(df: DataFrame) -> DataFrame:
        w = W.partitionBy("duoarea").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
        return df.select(
            "duoarea", "date", (F.lit(100000.0) + F.sum("weekly_change_bcf").over(w)).alias("storage_bcf"), "weekly_change_bcf",
            F.year("date").alias("year"), F.month("date").alias("month"), F.weekofyear("date").alias("week_of_year"),
        )

    @cached_property
    def wk_storage(self) -> DataFrame:
        return self._storage(self.wk_flow.select("duoarea", "date", (F.col("a_qty") - F.col("r_qty")).alias("weekly_change_bcf")))

    @cached_property
    def wk_all(self) -> DataFrame:
        """The five regions and their total as R48."""
        change = self.wk_flow.select("duoarea", "date", (F.col("a_qty") - F.col("r_qty")).alias("weekly_change_bcf"))
        both = change.groupingSets([[F.col("duoarea"), F.col("date")], [F.col("date")]], "duoarea", "date").agg(
            F.sum("weekly_change_bcf").alias("weekly_change_bcf")
        )
        return self._storage(both.withColumn("duoarea", F.coalesce("duoarea", F.lit("R48"))))

    @cached_property
    def storage_raw(self) -> DataFrame:
        return self.wk_storage.select(
            F.col("duoarea"), F.col("date").alias("period"), F.concat(F.lit("NW2_EPG0_SWO_"), "duoarea", F.lit("_BCF")).alias("series"),
            F.col("storage_bcf").alias("value"),
        )

    @cached_property
    def ordered(self) -> DataFrame:
        c = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.col("c_custkey").alias("o_custkey"), F.col("n_name").alias("state"), F.col("n_nationkey").alias("nation"), _area("n_regionkey").alias("duoarea")
        )
        return self.raw("orders").join(c, "o_custkey")

    @cached_property
    def nations(self) -> DataFrame:
        n = self.raw("nation").select(
            F.col("n_name").alias("state"), F.col("n_nationkey").alias("nation"), _area("n_regionkey").alias("duoarea"),
            (F.col("n_nationkey") + 1).cast("double").alias("population"),
        )
        return n

    @cached_property
    def state_weights(self) -> DataFrame:
        w = W.partitionBy("duoarea")
        return self.nations.select("state", "duoarea", "population", (F.col("population") / F.sum("population").over(w)).alias("weather_weight"))

    @cached_property
    def state_daily(self) -> DataFrame:
        """State temperatures: one row per (state, day) with orders."""
        t = F.lit(15.0) + F.avg("o_totalprice") / 4999.0
        days = self.ordered.groupBy("state", "duoarea", F.to_date("o_orderdate").alias("date")).agg(t.alias("temperature_f"))
        return degree_days(days).join(self.state_weights.select("state", "population", F.col("weather_weight").alias("population_weight")), "state")

    @cached_property
    def region_daily(self) -> DataFrame:
        t = F.lit(15.0) + F.avg("o_totalprice") / 4999.0
        return degree_days(self.ordered.groupBy("duoarea", F.to_date("o_orderdate").alias("date")).agg(t.alias("temperature_f")))

    @cached_property
    def wk_weather(self) -> DataFrame:
        return rollups.weekly_weather(self.region_daily, ["duoarea"], drop_incomplete=False)

    @cached_property
    def wk_weather_all(self) -> DataFrame:
        """Weekly weather of the five regions and, as R48, of all orders."""
        t = F.lit(15.0) + F.avg("o_totalprice") / 4999.0
        total = degree_days(self.raw("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(t.alias("temperature_f")))
        return rollups.weekly_weather(self.region_daily.unionByName(total.withColumn("duoarea", F.lit("R48"))), ["duoarea"], drop_incomplete=False)

    @cached_property
    def vintages(self) -> DataFrame:
        o = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("issued_at"))
        v = self.shipped.join(o, "l_orderkey").select(
            F.col("duoarea").alias("entity"), week_ending_friday("l_shipdate").cast("timestamp").alias("valid_at"), "issued_at",
            (F.col("issued_at") + F.expr("INTERVAL 1 DAY")).alias("retrieved_at"), F.col("l_extendedprice").alias("value"),
            F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line"),
        )
        return v.where(F.col("issued_at") < F.col("valid_at"))

    @cached_property
    def versions(self) -> DataFrame:
        return self.vintages.select("entity", "valid_at", "issued_at", "retrieved_at", "value")

    @cached_property
    def balance_vintages(self) -> DataFrame:
        q = F.col("quantity")
        return self.vintages.groupBy(F.to_date("valid_at").alias("date"), F.col("entity").alias("duoarea"), F.col("issued_at").alias("available_at")).agg(
            F.sum(q).alias("local_balance"), F.sum(F.when(F.col("flag") == "A", q).otherwise(-q)).alias("net_inflow_balancing")
        )

    @cached_property
    def scenarios(self) -> DataFrame:
        t = F.lit(15.0) + F.avg("value") / 997.0
        s = self.vintages.groupBy(F.to_date("valid_at").alias("date"), F.col("entity").alias("duoarea"), "issued_at").agg(t.alias("temperature_f"))
        s = degree_days(s)
        return s.select(
            "date", "duoarea", "issued_at", F.lit("archive").alias("provider"), F.lit("gfs").alias("model"),
            "temperature_f", (F.col("hdd") * 7).alias("hdd"), (F.col("cdd") * 7).alias("cdd"), F.lit(7.0).alias("weather_days"),
        )

    @cached_property
    def hours(self) -> DataFrame:
        label = F.lit(None).cast("string")
        for event, component in COMPONENT_OF_EVENT.items():
            label = F.when(F.col("event_type") == event, F.lit(component)).otherwise(label)
        return self.raw("events").groupBy(label.alias("component"), F.date_trunc("hour", "ts").alias("valid_at")).agg(
            (F.sum("value") * 1000.0 / 997.0).alias("mw")
        )

    @cached_property
    def fuel_hours(self) -> DataFrame:
        """Hours with both gas and coal."""
        wide = self.hours.groupBy("valid_at").pivot("component", ["gas", "coal"]).agg(F.sum("mw"))
        return wide.select("valid_at", F.col("gas").alias("gas_mw"), F.col("coal").alias("coal_mw"))

    @cached_property
    def power_vintages(self) -> DataFrame:
        h = self.hours.where(F.col("component").isin("load", "wind", "solar"))
        base = h.select("component", (F.col("valid_at") + F.expr("INTERVAL 168 HOURS")).alias("valid_at"), F.col("mw").alias("_b"))
        both = base.join(h, ["component", "valid_at"], "left")
        spread = both.select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("k"))
        start = F.date_trunc("day", F.col("valid_at") - F.expr("INTERVAL 1 SECOND"))
        issued = F.timestamp_add("DAY", -F.col("k"), start)
        return spread.select(
            "component", issued.alias("issued_at"), "valid_at", (issued + F.expr("INTERVAL 30 MINUTES")).alias("retrieved_at"),
            (F.col("_b") + 0.5 * (F.col("k") + 1)).alias("baseline_mw"), F.col("mw").alias("actual_mw"),
        )

    @cached_property
    def power_actuals(self) -> DataFrame:
        return self.hours.where(F.col("component").isin("load", "wind", "solar")).select("component", "valid_at", F.col("mw").alias("actual_mw"))

    @cached_property
    def crude_long(self) -> DataFrame:
        wk = self.wk_flow.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("a_qty", "r_qty", "no_qty", "nf_qty")])
        w = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)
        parts = wk.select(
            F.col("date").alias("period"), (F.col("a_qty") / 2.9).alias("production_kbpd"), (F.col("r_qty") / 2.9).alias("refinery_inputs_kbpd"),
            (F.col("no_qty") / 2.9).alias("imports_kbpd"), (F.col("nf_qty") / 2.9).alias("exports_kbpd"),
            (F.lit(1e6) + F.sum(F.col("a_qty") - F.col("r_qty")).over(w) / 7.0).alias("commercial_stocks_kb"),
            (F.lit(5e5) + F.sum(F.col("no_qty") - F.col("nf_qty")).over(w) / 7.0).alias("spr_stocks_kb"),
        )
        return parts.unpivot(["period"], list(CRUDE_PARTS), "component", "value")

    @cached_property
    def daily_price(self) -> DataFrame:
        return self.raw("orders").groupBy(F.to_date("o_orderdate").alias("period")).agg((F.avg("o_totalprice") / 49999.0).alias("value"))

    @cached_property
    def state_codes(self) -> DataFrame:
        a = F.char((F.floor(F.col("nation") / 5) + 65).cast("int"))
        b = F.char((F.pmod(F.col("nation"), F.lit(5)) + 65).cast("int"))
        return self.nations.select("state", "nation", "duoarea", F.concat(a, b).alias("abbr"))

    @cached_property
    def monthly_series(self) -> DataFrame:
        q = F.col("l_quantity")
        flag = lambda f: F.sum(F.when(F.col("l_returnflag") == f, q).otherwise(0.0))
        m = self.shipped.groupBy("nation", F.trunc("l_shipdate", "month").alias("period")).agg(
            flag("A").alias("a"), flag("N").alias("n"), flag("R").alias("r"), F.sum(q).alias("q"), F.avg("l_extendedprice").alias("p")
        ).join(self.state_codes.select("nation", "abbr"), "nation")
        code = lambda head, tail: F.concat(F.lit(head), "abbr", F.lit(tail))
        even = F.pmod("nation", F.lit(2)) == 0
        state = m.select("period", F.explode(F.array(
            F.struct(code("N3010", "2").alias("series"), F.col("a").alias("value")),
            F.struct(code("N3020", "2").alias("series"), (F.col("n") / 3.0).alias("value")),
            F.struct(code("N3035", "2").alias("series"), F.col("r").alias("value")),
            F.struct(code("N3045", "2").alias("series"), (F.col("q") / 3.0).alias("value")),
            F.struct(code("N3050", "3").alias("series"), (F.col("p") / 9973.0).alias("value")),
            F.struct(F.when(even, code("N9050", "2")).otherwise(code("NA1160_S", "_2")).alias("series"), (F.col("q") * 3).alias("value")),
        )).alias("s")).select("period", "s.series", "s.value")
        total = m.groupBy("period").agg(F.sum("q").alias("q"))
        us = total.select("period", F.explode(F.array(*[
            F.struct(F.lit(c).alias("series"), (F.col("q") * k).alias("value"))
            for c, k in (("N9070US2", 2.5), ("N9050US2", 3.0), ("N9140US2", 2.0), ("N9160US2", 1 / 7.9), ("N9170US2", 1 / 15.7))
        ])).alias("s")).select("period", "s.series", "s.value")
        return state.unionByName(us)

    @cached_property
    def archive(self) -> DataFrame:
        """State ensemble: three members per day, issued on the eve of each reporting week."""
        t = F.lit(15.0) + F.avg("l_extendedprice") / 997.0
        d = self.shipped.groupBy("state", "duoarea", "l_shipdate", F.col("l_returnflag").alias("ensemble_member")).agg(t.alias("temperature_f"))
        issued = F.date_sub(week_ending_friday("l_shipdate"), 7).cast("timestamp")
        return degree_days(d).select(
            F.lit("open-meteo").alias("provider"), F.lit("gfs_seamless").alias("model"), F.date_format(issued, "yyyyMMdd").alias("model_run"),
            "ensemble_member", issued.alias("issued_at"), F.col("l_shipdate").alias("valid_start"),
            (F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).alias("valid_end"), "state", "duoarea", "temperature_f", "hdd", "cdd",
            F.lit(1.0).alias("coverage"),
        )

    @cached_property
    def region_archive(self) -> DataFrame:
        t = F.lit(15.0) + F.avg("l_extendedprice") / 997.0
        d = self.shipped.groupBy("duoarea", "l_shipdate", F.col("l_returnflag").alias("ensemble_member")).agg(t.alias("temperature_f"))
        issued = F.date_sub(week_ending_friday("l_shipdate"), 7).cast("timestamp")
        return degree_days(d).select(
            F.lit("open-meteo").alias("provider"), F.lit("gfs_seamless").alias("model"), F.date_format(issued, "yyyyMMdd").alias("model_run"),
            "ensemble_member", issued.alias("issued_at"), F.col("l_shipdate").alias("valid_start"),
            (F.col("l_shipdate") + F.expr("INTERVAL 1 DAY")).alias("valid_end"), F.lit("REGIONAL").alias("state"), "duoarea",
            "temperature_f", "hdd", "cdd", F.lit(1.0).alias("coverage"),
        )

    @cached_property
    def base_predictions(self) -> DataFrame:
        """Four-week-ahead damped last changes of all six regions; origins of 1996 lack quantiles."""
        start = F.lit("1995-01-06").cast("date")
        weeks = staged(self.wk_all.select("duoarea", "date", "weekly_change_bcf"), "weeks")
        last = weeks.where(F.pmod(F.datediff("date", start), F.lit(28)) == 0)
        ahead = last.select("duoarea", F.col("date").alias("forecast_origin"), F.col("weekly_change_bcf").alias("_l"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("horizon"))
        rows = ahead.select(
            F.col("duoarea").alias("region"), "forecast_origin", "horizon", F.expr("date_add(forecast_origin, 7 * horizon)").alias("date"),
            (F.col("_l") / (F.col("horizon") + 1)).alias("predicted_weekly_change"), F.lit("damped").alias("model_key"),
        )
        actual = weeks.select(F.col("duoarea").alias("region"), "date", F.col("weekly_change_bcf").alias("actual_weekly_change"))
        p, known = F.col("predicted_weekly_change"), F.year("forecast_origin") != 1996
        whole = reconcile.complete_groups(rows.join(actual, ["region", "date"]), ["forecast_origin", "date", "horizon"])
        return whole.withColumns({"p10": F.when(known, p - 50), "p50": F.when(known, p), "p90": F.when(known, p + 40)})

    @cached_property
    def weight_history(self) -> DataFrame:
        """Gas load of each state by month of availability."""
        return self.ordered.groupBy("state", "duoarea", F.date_trunc("month", "o_orderdate").alias("available_at")).agg(
            F.count(F.lit(1)).cast("double").alias("gas_load")
        )


def _week(d: str) -> str:
    return f"(CAST({d} AS DATE) + CAST((12 - isodow({d})) % 7 AS INTEGER))"


_T_REGION = "15.0 + avg(o_totalprice) / 4999.0"
_HDD = "greatest(0.0, 65.0 - temperature_f) AS hdd, greatest(0.0, temperature_f - 65.0) AS cdd"
_CAL = "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS week_of_year"
_STORE = ("SELECT duoarea, date, 100000.0 + sum(weekly_change_bcf) OVER (PARTITION BY duoarea ORDER BY date) AS storage_bcf, "
          f"weekly_change_bcf, {_CAL} FROM ")

CTES: dict[str, str] = {
    "suppliers": "SELECT s_suppkey AS l_suppkey, n_name AS state, n_nationkey AS nation, 'R3' || (n_regionkey + 1) AS duoarea "
                 "FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "shipped": "SELECT lineitem.*, s.state, s.nation, s.duoarea FROM lineitem JOIN suppliers s USING (l_suppkey)",
    "wk_flow": f"SELECT duoarea, {_week('l_shipdate')} AS date, "
               "sum(CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0.0 END) AS a_qty, sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0.0 END) AS r_qty, "
               "sum(CASE WHEN l_returnflag='N' AND l_linestatus='O' THEN l_quantity ELSE 0.0 END) AS no_qty, "
               "sum(CASE WHEN l_returnflag='N' AND l_linestatus='F' THEN l_quantity ELSE 0.0 END) AS nf_qty FROM shipped GROUP BY 1, 2",
    "wk_storage": f"{_STORE} (SELECT duoarea, date, a_qty - r_qty AS weekly_change_bcf FROM wk_flow)",
    "wk_all": f"{_STORE} (SELECT coalesce(duoarea, 'R48') AS duoarea, date, sum(a_qty - r_qty) AS weekly_change_bcf FROM wk_flow "
              "GROUP BY GROUPING SETS ((duoarea, date), (date)))",
    "storage_raw": "SELECT duoarea, date AS period, 'NW2_EPG0_SWO_' || duoarea || '_BCF' AS series, storage_bcf AS value FROM wk_storage",
    "ordered": "SELECT orders.*, n_name AS state, n_nationkey AS nation, 'R3' || (n_regionkey + 1) AS duoarea FROM orders "
               "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    "nations": "SELECT n_name AS state, n_nationkey AS nation, 'R3' || (n_regionkey + 1) AS duoarea, CAST(n_nationkey + 1 AS DOUBLE) AS population FROM nation",
    "state_weights": "SELECT state, duoarea, population, population / sum(population) OVER (PARTITION BY duoarea) AS weather_weight FROM nations",
    "state_daily": f"SELECT d.*, {_HDD}, w.population, w.weather_weight AS population_weight FROM (SELECT state, duoarea, CAST(o_orderdate AS DATE) AS date, "
                   f"{_T_REGION} AS temperature_f FROM ordered GROUP BY 1, 2, 3) d JOIN (SELECT state, population, weather_weight FROM state_weights) w USING (state)",
    "region_daily": f"SELECT d.*, {_HDD} FROM (SELECT duoarea, CAST(o_orderdate AS DATE) AS date, {_T_REGION} AS temperature_f FROM ordered GROUP BY 1, 2) d",
    "wk_weather": f"SELECT duoarea, {_week('date')} AS date, avg(temperature_f) AS temperature_f, sum(hdd) AS hdd, sum(cdd) AS cdd, "
                  "CAST(count(*) AS INTEGER) AS weather_days FROM region_daily GROUP BY 1, 2",
    "wk_weather_all": f"SELECT duoarea, {_week('date')} AS date, avg(temperature_f) AS temperature_f, sum(hdd) AS hdd, sum(cdd) AS cdd, "
                      f"CAST(count(*) AS INTEGER) AS weather_days FROM (SELECT duoarea, date, temperature_f, hdd, cdd FROM region_daily UNION ALL "
                      f"SELECT 'R48', date, temperature_f, {_HDD} FROM (SELECT CAST(o_orderdate AS DATE) AS date, {_T_REGION} AS temperature_f FROM orders GROUP BY 1)) GROUP BY 1, 2",
    "vintages": f"SELECT duoarea AS entity, CAST({_week('l_shipdate')} AS TIMESTAMP) AS valid_at, o_orderdate AS issued_at, o_orderdate + INTERVAL 1 DAY AS retrieved_at, "
                "l_extendedprice AS value, l_quantity AS quantity, l_returnflag AS flag, l_linenumber AS line FROM shipped JOIN orders ON l_orderkey = o_orderkey "
                f"WHERE o_orderdate < CAST({_week('l_shipdate')} AS TIMESTAMP)",
    "balance_vintages": "SELECT CAST(valid_at AS DATE) AS date, entity AS duoarea, issued_at AS available_at, sum(quantity) AS local_balance, "
                        "sum(CASE WHEN flag='A' THEN quantity ELSE -quantity END) AS net_inflow_balancing FROM vintages GROUP BY 1, 2, 3",
    "scenarios": "SELECT date, duoarea, issued_at, 'archive' AS provider, 'gfs' AS model, temperature_f, greatest(0.0, 65.0 - temperature_f) * 7 AS hdd, "
                 "greatest(0.0, temperature_f - 65.0) * 7 AS cdd, 7.0::DOUBLE AS weather_days FROM (SELECT CAST(valid_at AS DATE) AS date, entity AS duoarea, issued_at, "
                 "15.0 + avg(value) / 997.0 AS temperature_f FROM vintages GROUP BY 1, 2, 3)",
    "hours": "SELECT CASE event_type WHEN 'view' THEN 'load' WHEN 'click' THEN 'wind' WHEN 'signup' THEN 'solar' WHEN 'purchase' THEN 'gas' WHEN 'error' THEN 'coal' END AS component, "
             "date_trunc('hour', ts) AS valid_at, sum(value) * 1000.0 / 997.0 AS mw FROM events GROUP BY 1, 2",
    "fuel_hours": "SELECT valid_at, sum(mw) FILTER (component='gas') AS gas_mw, sum(mw) FILTER (component='coal') AS coal_mw FROM hours GROUP BY 1",
    "power_vintages": "SELECT component, issued_at, valid_at, issued_at + INTERVAL 30 MINUTE AS retrieved_at, b + 0.5 * (k + 1) AS baseline_mw, actual_mw FROM ("
                      "SELECT base.component, base.valid_at, base.b, h.mw AS actual_mw, k, date_trunc('day', base.valid_at - INTERVAL 1 SECOND) - to_days(CAST(k AS INTEGER)) AS issued_at "
                      "FROM (SELECT component, valid_at + INTERVAL 168 HOUR AS valid_at, mw AS b FROM hours WHERE component IN ('load','wind','solar')) base "
                      "LEFT JOIN hours h ON h.component = base.component AND h.valid_at = base.valid_at, range(0, 7) r(k))",
    "power_actuals": "SELECT component, valid_at, mw AS actual_mw FROM hours WHERE component IN ('load','wind','solar')",
    "crude_wide": "SELECT date AS period, a / 2.9 AS production_kbpd, r / 2.9 AS refinery_inputs_kbpd, i / 2.9 AS imports_kbpd, e / 2.9 AS exports_kbpd, "
                  "1e6 + sum(a - r) OVER (ORDER BY date) / 7.0 AS commercial_stocks_kb, 5e5 + sum(i - e) OVER (ORDER BY date) / 7.0 AS spr_stocks_kb FROM ("
                  "SELECT date, sum(a_qty) AS a, sum(r_qty) AS r, sum(no_qty) AS i, sum(nf_qty) AS e FROM wk_flow GROUP BY 1)",
    "crude_long": "SELECT period, component, value FROM (UNPIVOT crude_wide ON production_kbpd, refinery_inputs_kbpd, imports_kbpd, exports_kbpd, commercial_stocks_kb, spr_stocks_kb "
                  "INTO NAME component VALUE value)",
    "crude_balance": "SELECT *, commercial_stock_change_mmbbl - fundamental_balance_mmbbl AS balance_adjustment_mmbbl FROM (SELECT *, "
                     "production_mmbbl + imports_mmbbl - refinery_inputs_mmbbl - exports_mmbbl - spr_stock_change_mmbbl AS fundamental_balance_mmbbl FROM ("
                     "SELECT period AS date, production_kbpd*7.0/1000.0 AS production_mmbbl, imports_kbpd*7.0/1000.0 AS imports_mmbbl, refinery_inputs_kbpd*7.0/1000.0 AS refinery_inputs_mmbbl, "
                     "exports_kbpd*7.0/1000.0 AS exports_mmbbl, commercial_stocks_kb/1000.0 AS commercial_stocks_mmbbl, spr_stocks_kb/1000.0 AS spr_stocks_mmbbl, "
                     "commercial_stocks_kb/1000.0 - lag(commercial_stocks_kb/1000.0) OVER (ORDER BY period) AS commercial_stock_change_mmbbl, "
                     "spr_stocks_kb/1000.0 - lag(spr_stocks_kb/1000.0) OVER (ORDER BY period) AS spr_stock_change_mmbbl FROM crude_wide))",
    "daily_price": "SELECT CAST(o_orderdate AS DATE) AS period, avg(o_totalprice) / 49999.0 AS value FROM orders GROUP BY 1",
    "state_codes": "SELECT state, nation, duoarea, chr(65 + nation // 5) || chr(65 + nation % 5) AS abbr FROM nations",
    "month_state": "SELECT c.abbr, c.duoarea, c.nation, period, a, n, r, q, p FROM (SELECT nation, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, "
                   "sum(CASE WHEN l_returnflag='A' THEN l_quantity ELSE 0.0 END) AS a, sum(CASE WHEN l_returnflag='N' THEN l_quantity ELSE 0.0 END) AS n, "
                   "sum(CASE WHEN l_returnflag='R' THEN l_quantity ELSE 0.0 END) AS r, sum(l_quantity) AS q, avg(l_extendedprice) AS p FROM shipped GROUP BY 1, 2) "
                   "JOIN state_codes c USING (nation)",
    "monthly_series": "SELECT period, unnest([{'series':'N3010'||abbr||'2','value':a},{'series':'N3020'||abbr||'2','value':n/3.0},{'series':'N3035'||abbr||'2','value':r},"
                      "{'series':'N3045'||abbr||'2','value':q/3.0},{'series':'N3050'||abbr||'3','value':p/9973.0},"
                      "{'series':CASE WHEN nation%2=0 THEN 'N9050'||abbr||'2' ELSE 'NA1160_S'||abbr||'_2' END,'value':q*3}], recursive := true) FROM month_state UNION ALL "
                      "SELECT period, unnest([{'series':'N9070US2','value':q*2.5},{'series':'N9050US2','value':q*3.0},{'series':'N9140US2','value':q*2.0},"
                      "{'series':'N9160US2','value':q/7.9},{'series':'N9170US2','value':q/15.7}], recursive := true) FROM (SELECT period, sum(q) AS q FROM month_state GROUP BY 1)",
    "archive": f"SELECT 'open-meteo' AS provider, 'gfs_seamless' AS model, strftime(issued_at, '%Y%m%d') AS model_run, ensemble_member, issued_at, valid_start, "
               f"valid_start + INTERVAL 1 DAY AS valid_end, state, duoarea, temperature_f, {_HDD}, 1.0::DOUBLE AS coverage FROM (SELECT state, duoarea, l_shipdate AS valid_start, l_returnflag AS ensemble_member, "
               f"15.0 + avg(l_extendedprice) / 997.0 AS temperature_f, CAST({_week('l_shipdate')} - 7 AS TIMESTAMP) AS issued_at FROM shipped GROUP BY 1, 2, 3, 4)",
    "region_archive": f"SELECT 'open-meteo' AS provider, 'gfs_seamless' AS model, strftime(issued_at, '%Y%m%d') AS model_run, ensemble_member, issued_at, valid_start, "
                      f"valid_start + INTERVAL 1 DAY AS valid_end, 'REGIONAL' AS state, duoarea, temperature_f, {_HDD}, 1.0::DOUBLE AS coverage FROM (SELECT duoarea, l_shipdate AS valid_start, l_returnflag AS ensemble_member, "
                      f"15.0 + avg(l_extendedprice) / 997.0 AS temperature_f, CAST({_week('l_shipdate')} - 7 AS TIMESTAMP) AS issued_at FROM shipped GROUP BY 1, 2, 3)",
    "base_predictions": "SELECT region, forecast_origin, horizon, b.date, predicted_weekly_change, 'damped' AS model_key, a.weekly_change_bcf AS actual_weekly_change, "
                        "CASE WHEN year(forecast_origin) <> 1996 THEN predicted_weekly_change - 50 END AS p10, CASE WHEN year(forecast_origin) <> 1996 THEN predicted_weekly_change END AS p50, "
                        "CASE WHEN year(forecast_origin) <> 1996 THEN predicted_weekly_change + 40 END AS p90 FROM (SELECT duoarea AS region, date AS forecast_origin, CAST(h AS INTEGER) AS horizon, "
                        "date + CAST(7 * h AS INTEGER) AS date, weekly_change_bcf / (h + 1) AS predicted_weekly_change FROM wk_all, range(1, 5) x(h) WHERE date_diff('day', DATE '1995-01-06', date) % 28 = 0) b "
                        "JOIN wk_all a ON a.duoarea = b.region AND a.date = b.date QUALIFY count(*) OVER (PARTITION BY forecast_origin, b.date, horizon) = 6",
    "weight_history": "SELECT state, duoarea, date_trunc('month', o_orderdate)::TIMESTAMP AS available_at, CAST(count(*) AS DOUBLE) AS gas_load FROM ordered GROUP BY 1, 2, 3",
}


def _needed(body: str) -> list[str]:
    """Fixture names a statement uses, dependencies first."""
    import re

    order: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(body)
    return order


def with_fixtures(body: str) -> str:
    """Prefix a statement with the fixture tables it uses."""
    text = " ".join(body.split())
    names = _needed(text)
    ctes = ", ".join(f"{n} AS ({CTES[n]})" for n in names)
    if text.upper().startswith("WITH "):
        rest = text[5:]
        return f"WITH RECURSIVE {ctes}, {rest}" if ctes else f"WITH RECURSIVE {rest}"
    return f"WITH {ctes} {text}" if ctes else text
