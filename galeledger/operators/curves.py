"""Power curves: piecewise-linear lookup as an equi-join on speed bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

BIN_MS = 0.5


def curve_points(catalogue: DataFrame) -> DataFrame:
    """(turbine_type, i, v, p) from the nested ``power_curve`` array of pairs."""
    return catalogue.select("turbine_type", F.posexplode("power_curve").alias("i", "_pair")).select(
        "turbine_type", "i", F.col("_pair")[0].alias("v"), F.col("_pair")[1].alias("p")
    )


def curve_segments(points: DataFrame) -> DataFrame:
    """Linear pieces. Half-open on the right except the last, which is closed, so
    that a speed exactly at the last knot takes that knot's power."""
    w = Window.partitionBy("turbine_type").orderBy("i")
    pieces = points.select(
        "turbine_type", F.col("v").alias("v0"), F.col("p").alias("p0"),
        F.lead("v").over(w).alias("v1"), F.lead("p").over(w).alias("p1"),
        F.lead("v", 2).over(w).isNull().alias("is_last"),
    )
    return pieces.where(F.col("v1").isNotNull() & (F.col("v1") > F.col("v0")))


def curve_limits(points: DataFrame) -> DataFrame:
    return points.groupBy("turbine_type").agg(
        F.min("v").alias("v_first"), F.max("v").alias("v_last"), F.max("p").alias("p_max")
    )


def rated_speed(points: DataFrame, rated: DataFrame) -> DataFrame:
    """First speed with at least 99 % of rated power, else the highest speed."""
    return (
        points.join(rated.select("turbine_type", "rated_power_kw"), "turbine_type")
        .groupBy("turbine_type")
        .agg(F.coalesce(
            F.min_by("v", F.when(F.col("p") >= 0.99 * F.col("rated_power_kw"), F.col("i"))), F.max("v")
        ).alias("rated_ws"))
    )


def expected_power(df: DataFrame, points: DataFrame, speed: str, name: str = "expected_kwh", cut_out: bool = False) -> DataFrame:
    """Interpolated power at ``speed``: 0 below the first knot; above the last knot
    the curve maximum, or 0 with ``cut_out=True``. Hourly kW equals kWh.

    Each curve piece is listed under the speed bins it touches, so a row meets one
    or two pieces in a hash join instead of the whole curve.
    """
    pieces = curve_segments(points).withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col("v0") / BIN_MS), F.floor(F.col("v1") / BIN_MS)))
    ).withColumnRenamed("turbine_type", "_type")
    limits = curve_limits(points)
    s = F.col(speed)
    rows = df.withColumn("_bin_of", F.floor(s / BIN_MS))
    inside = (s >= pieces["v0"]) & ((s < pieces["v1"]) | (pieces["is_last"] & (s == pieces["v1"])))
    joined = rows.join(
        pieces, (rows["turbine_type"] == pieces["_type"]) & (rows["_bin_of"] == pieces["_bin"]) & inside, "left"
    ).join(limits, "turbine_type", "left")
    on_piece = F.col("p0") + (s - F.col("v0")) * (F.col("p1") - F.col("p0")) / (F.col("v1") - F.col("v0"))
    above = F.lit(0.0) if cut_out else F.col("p_max")
    power = F.when(s < F.col("v_first"), F.lit(0.0)).when(s > F.col("v_last"), above).otherwise(on_piece)
    return joined.withColumn(name, power).select(*df.columns, name)
