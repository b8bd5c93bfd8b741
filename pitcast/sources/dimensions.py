"""Region, state and series dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Storage regions, their states, slugs and labels; excluded states.
REGIONS = {
    "R31": ("east", "East", (
        "Connecticut", "Delaware", "District of Columbia", "Florida", "Georgia", "Maine", "Maryland",
        "Massachusetts", "New Hampshire", "New Jersey", "New York", "North Carolina", "Ohio",
        "Pennsylvania", "Rhode Island", "South Carolina", "Vermont", "Virginia", "West Virginia",
    )),
    "R32": ("midwest", "Midwest", (
        "Illinois", "Indiana", "Iowa", "Kentucky", "Michigan", "Minnesota", "Missouri", "Tennessee",
        "Wisconsin",
    )),
    "R33": ("south_central", "South Central", (
        "Alabama", "Arkansas", "Kansas", "Louisiana", "Mississippi", "Oklahoma", "Texas",
    )),
    "R34": ("mountain", "Mountain", (
        "Arizona", "Colorado", "Idaho", "Montana", "Nebraska", "Nevada", "New Mexico", "North Dakota",
        "South Dakota", "Utah", "Wyoming",
    )),
    "R35": ("pacific", "Pacific", (
        "California", "Oregon", "Washington",
    )),
}
PARENT = ("R48", "lower48", "Lower 48 States")
LEGACY = {"R01": "R31", "R02": "R32", "R03": "R34", "R04": "R35", "R05": "R33"}
EXCLUDED_STATES = ("Alaska", "Hawaii", "Puerto Rico")


def region_dimension(spark: SparkSession, include_legacy: bool = False) -> DataFrame:
    """duoarea, slug, label and canonical code."""
    rows = [(PARENT[0], PARENT[1], PARENT[2], PARENT[0])]
    rows += [(code, slug, label, code) for code, (slug, label, _) in REGIONS.items()]
    if include_legacy:
        rows += [(old, REGIONS[new][0], REGIONS[new][1], new) for old, new in LEGACY.items()]
    return spark.createDataFrame(rows, "duoarea string, slug string, label string, canonical string")


def region_states(spark: SparkSession, include_legacy: bool = False) -> DataFrame:
    """One row per (duoarea, state); the parent holds every state of its children."""
    rows = [(code, s) for code, (_, _, names) in REGIONS.items() for s in names]
    rows += [(PARENT[0], s) for _, s in rows]
    if include_legacy:
        rows += [(old, s) for old, new in LEGACY.items() for code, s in rows if code == new]
    return spark.createDataFrame(rows, "duoarea string, state string")


def require_known_region(code: str, include_legacy: bool = False) -> str:
    known = {PARENT[0], *REGIONS} | (set(LEGACY) if include_legacy else set())
    if code not in known:
        raise ValueError(f"Unknown storage region {code!r}; expected one of {sorted(known)}.")
    return code


def population_locations(df: DataFrame, excluded: DataFrame | None = None, name: str = "state", population: str = "population") -> DataFrame:
    """States outside the excluded ones with their share of the total population."""
    kept = df.where(~F.col(name).isin(*EXCLUDED_STATES)) if excluded is None else df.join(excluded, name, "left_anti")
    return kept.withColumn("weight", F.col(population) / F.sum(population).over(W.partitionBy()))


def read_locations(spark: SparkSession, path: str) -> DataFrame:
    """Location CSV with a declared schema."""
    schema = "state string, population double, latitude double, longitude double"
    return population_locations(spark.read.schema(schema).option("header", "true").csv(path))


def regional_locations(locations: DataFrame, states: DataFrame, population: str = "population") -> DataFrame:
    """Locations of each region with weights renormalized inside it; a state without a location stops the job."""
    joined = states.select("duoarea", "state").join(locations.drop("weight").withColumn("_found", F.lit(True)), "state", "left")
    lost = F.raise_error(F.concat_ws(" ", F.lit("No location for state"), "state", F.lit("of region"), "duoarea")).cast("boolean")
    whole = joined.where(F.coalesce("_found", lost)).drop("_found")
    return whole.withColumn("weight", F.col(population) / F.sum(population).over(W.partitionBy("duoarea")))


def missing_region_states(locations: DataFrame, states: DataFrame) -> DataFrame:
    return states.select("duoarea", "state").join(locations.select("state").distinct(), "state", "left_anti")


def stamp_locations(daily: DataFrame, locations: DataFrame) -> DataFrame:
    """Current population and weight on every stored row of a state."""
    drop = [c for c in ("population", "population_weight") if c in daily.columns]
    dim = locations.select("state", "population", F.col("weight").alias("population_weight"))
    return daily.drop(*drop).join(dim, "state")
