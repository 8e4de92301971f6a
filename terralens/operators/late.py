"""Per-period aggregates by event time, corrected as late records arrive.

The records form a triangle of event period by arrival period. Each cell is aggregated once; running sums
over the arrivals of an event period then give every revision its count had. What a cell means follows from these sums:
a period's count is published ``grace_h`` hours after its end, a cell that raises it later is *late*, one beyond
``cutoff_h`` is *cut* and never counted; records get their outcome from their cell. SQL expressions only: one
partial aggregation before the shuffle, windows only over cells (periods times lag hours, not records).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_S, HOUR_S = 86400, 3600


def place(records: DataFrame, event: str, arrival: str) -> DataFrame:
    """``records`` plus ``event_day, lag_h``, the cell of the triangle that each falls into.

    ``event`` and ``arrival`` are seconds since 1970. ``lag_h`` is the arrival period: hours after the end
    of the UTC day of the event, rounded up, 0 for arrivals before that end.
    Records without event or arrival time are dropped: they name no cell.
    """
    day = F.floor(F.col(event) / DAY_S)
    lag = F.greatest(F.lit(0), F.ceil((F.col(arrival) - (day + 1) * DAY_S) / HOUR_S)).cast("bigint")
    return records.where(F.col(event).isNotNull() & F.col(arrival).isNotNull()).withColumns({
        "event_day": F.substring(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")).cast("string"), 1, 10), "lag_h": lag,
    })


def triangle(placed: DataFrame, keys: tuple[str, ...] = (), grace_h: int = 6, cutoff_h: int = 72) -> DataFrame:
    """Cells ``keys, event_day, lag_h`` with ``arrived`` (records of the cell), ``revision`` (1 for the first arrival
    period of the day), ``total`` (count as corrected up to and with that arrival period, arrivals beyond the cut-off
    never counted), ``published`` (the total at the end of the grace, 0 if nothing had come), ``beyond`` (records cut off
    so far) and ``outcome``: ``on_time``, ``late`` (raises the published count) or ``cut`` (beyond the cut-off). Bounds
    belong to the earlier class."""
    cells = placed.groupBy(*keys, "event_day", "lag_h").agg(F.count(F.lit(1)).alias("arrived"))
    period = Window.partitionBy(*keys, "event_day")
    upto = period.orderBy("lag_h").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.when(F.col("lag_h") <= cutoff_h, F.col("arrived")).otherwise(0)
    cells = cells.withColumns({
        "revision": F.row_number().over(period.orderBy("lag_h")).cast("bigint"), "total": F.sum(kept).over(upto), "beyond": F.sum(F.col("arrived") - kept).over(upto),
    })
    cells = cells.withColumn("published", F.coalesce(F.max(F.when(F.col("lag_h") <= grace_h, F.col("total"))).over(period), F.lit(0)))
    return cells.withColumn("outcome", F.when(F.col("beyond") > 0, "cut").when(F.col("total") > F.col("published"), "late").otherwise("on_time"))


def with_outcome(placed: DataFrame, cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``placed`` plus the ``outcome`` of each record's cell in ``cells``, the triangle of these records.

    A column ``outcome`` of ``placed`` is replaced; null keys meet null keys.
    """
    on = [*keys, "event_day", "lag_h"]
    c = cells.select(*[F.col(k).alias(f"_terralens_{k}") for k in on], F.col("outcome").alias("_terralens_outcome"))
    met = placed.join(c, [F.col(k).eqNullSafe(F.col(f"_terralens_{k}")) for k in on])
    return met.withColumn("outcome", F.col("_terralens_outcome")).drop("_terralens_outcome", *[f"_terralens_{k}" for k in on])
