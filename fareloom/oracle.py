"""The same results as plain SQL over the driver's tables, for an independent engine.

Exact sums are taken here over one 128-bit integer, so this is not
a copy of how the Spark side adds up.
"""

from __future__ import annotations

from fareloom.config import FEWER_ZONES, DateWindow, TableNames, TripRules, WarehouseConfig
from fareloom.contracts import TRIP_SCHEMA

DEFAULT = WarehouseConfig(database="")

RAW_BATCH = """
SELECT pickup AS lpep_pickup_datetime,
       pickup + to_minutes((l_orderkey * 11 + l_linenumber) % 90 - 2) AS lpep_dropoff_datetime,
       CAST(l_orderkey % 270 AS INTEGER) AS "PULocationID",
       CAST((l_orderkey * 7 + l_linenumber) % 270 AS INTEGER) AS "DOLocationID",
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS passenger_count,
       CAST((l_orderkey * l_linenumber) % 200 - 5 AS DOUBLE) / CAST(10 AS DOUBLE) AS trip_distance,
       l_extendedprice / CAST(1000 AS DOUBLE) - 2 AS fare_amount,
       l_discount * 10 AS tip_amount,
       l_tax * 10 AS tolls_amount,
       CAST((l_orderkey * 13 + l_linenumber) % 10000 - 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS total_amount,
       CAST(l_linenumber AS DOUBLE) AS payment_type
FROM (SELECT *, TIMESTAMP '2025-03-25 00:00:00' + to_minutes((l_orderkey * 97) % 108000) AS pickup FROM lineitem)
"""

RAW_STREAM = """
SELECT 'evt-' || CAST(event_id // 10 * 9 + least(event_id % 10, 8) AS VARCHAR) AS event_id,
       pickup AS pickup_datetime,
       pickup + to_milliseconds((user_id + 1) * 10000 + (event_id % 3) * 500) AS dropoff_datetime,
       CAST(pickup AS DATE) AS pickup_date,
       user_id % 265 + 1 AS pickup_location_id,
       (user_id * 7) % 265 + 1 AS dropoff_location_id,
       event_id % 5 AS passenger_count,
       value / CAST(25 AS DOUBLE) + CAST(0.01 AS DOUBLE) AS trip_distance,
       value AS fare_amount,
       CAST(0 AS DOUBLE) AS tip_amount,
       CAST(0 AS DOUBLE) AS tolls_amount,
       value AS total_amount,
       event_id % 6 AS payment_type,
       'stream' AS source_type,
       TIMESTAMP '2025-08-01 00:00:00' + to_minutes(event_id) AS ingestion_time
FROM (SELECT *, ts + to_days(CAST(517 + 35 * (event_id % 2) AS INTEGER)) AS pickup FROM events)
"""

DIGEST = """sha256(CAST(lpep_pickup_datetime AS VARCHAR) || '|' || CAST(lpep_dropoff_datetime AS VARCHAR) || '|' ||
  CAST("PULocationID" AS VARCHAR) || '|' || CAST("DOLocationID" AS VARCHAR) || '|' ||
  CAST(trip_distance AS VARCHAR) || '|' || CAST(total_amount AS VARCHAR))"""

CONFORM_BATCH = f"""
SELECT {DIGEST} AS trip_id,
       lpep_pickup_datetime AS pickup_datetime,
       lpep_dropoff_datetime AS dropoff_datetime,
       CAST(lpep_pickup_datetime AS DATE) AS pickup_date,
       CAST("PULocationID" AS BIGINT) AS pickup_location_id,
       CAST("DOLocationID" AS BIGINT) AS dropoff_location_id,
       coalesce(CAST(round(passenger_count) AS BIGINT), 1) AS passenger_count,
       trip_distance, fare_amount, tip_amount, tolls_amount, total_amount,
       CAST(round(payment_type) AS BIGINT) AS payment_type,
       'batch' AS source_type,
       TIMESTAMP '2025-08-01 00:00:00' AS ingestion_time
FROM """

CONFORM_STREAM = """
SELECT event_id AS trip_id, pickup_datetime, dropoff_datetime, pickup_date, pickup_location_id, dropoff_location_id,
       passenger_count, trip_distance, fare_amount, tip_amount, tolls_amount, total_amount, payment_type,
       source_type, ingestion_time
FROM """


def _within(window: DateWindow) -> str:
    return f"BETWEEN '{window.first}' AND '{window.last}'"


def _zone(rules: TripRules) -> str:
    return f"BETWEEN {rules.lowest_zone} AND {rules.highest_zone}"


WINDOW_BATCH = f"SELECT * FROM raw_batch WHERE CAST(lpep_pickup_datetime AS DATE) {_within(DEFAULT.batch_window)}"
WINDOW_STREAM = f"SELECT * FROM raw_stream WHERE pickup_date {_within(DEFAULT.stream_window)}"

VALID_BATCH = f"""
SELECT * FROM window_batch
WHERE lpep_dropoff_datetime > lpep_pickup_datetime
  AND "PULocationID" {_zone(DEFAULT.rules)} AND "DOLocationID" {_zone(DEFAULT.rules)}
  AND trip_distance > 0 AND fare_amount >= 0 AND total_amount > 0
"""


def _latest(table: str) -> str:
    return f"""
SELECT * EXCLUDE (n) FROM (
  SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY ingestion_time DESC NULLS LAST,
    fare_amount NULLS LAST, tip_amount NULLS LAST, tolls_amount NULLS LAST, passenger_count NULLS LAST,
    payment_type NULLS LAST, pickup_datetime NULLS LAST, dropoff_datetime NULLS LAST, trip_distance NULLS LAST,
    total_amount NULLS LAST, pickup_location_id NULLS LAST, dropoff_location_id NULLS LAST,
    pickup_date NULLS LAST, source_type NULLS LAST) AS n
  FROM {table}) WHERE n = 1
"""


# The unit of exact sums, 2**-53; a double of at least 1 is a whole number of these.
UNIT = 2**53


def _cents(column: str, divisor: str) -> str:
    """The sum of a column, to the nearest billionth, over a divisor in cents, half away from zero."""
    units = f"sum(CAST({column} * {UNIT}.0 AS HUGEINT))"
    billionths = f"(2000000000::HUGEINT * abs({units}) + {UNIT}::HUGEINT) // {2 * UNIT}::HUGEINT"
    doubled = f"(200 * ({billionths}) + 1000000000::HUGEINT * {divisor}) // (2000000000::HUGEINT * {divisor})"
    return f"sign({units}) * CAST({doubled} AS DOUBLE) / 100"


def _mean(column: str) -> str:
    return _cents(column, f"count({column})")


def _sum(column: str) -> str:
    return _cents(column, "1")


SECONDS = "date_sub('second', pickup_datetime, dropoff_datetime)"

DAILY = f"""
SELECT pickup_date, source_type, count(*) AS trip_count, {_sum('total_amount')} AS total_revenue,
       {_mean('total_amount')} AS average_total_amount, {_mean('trip_distance')} AS average_trip_distance,
       CAST((200 * sum({SECONDS}) + 60 * count({SECONDS})) // (120 * count({SECONDS})) AS DOUBLE) / 100
         AS average_duration_minutes
FROM int_trips GROUP BY pickup_date, source_type
"""

MONTHLY = f"""
SELECT CAST(date_trunc('month', pickup_date) AS DATE) AS pickup_month, source_type, count(*) AS trip_count,
       {_sum('total_amount')} AS total_revenue, {_mean('total_amount')} AS average_total_amount,
       {_mean('trip_distance')} AS average_trip_distance
FROM int_trips GROUP BY 1, 2
"""


def _zone_trips(table: str) -> str:
    return f"""
SELECT {DIGEST} AS trip_id, CAST(lpep_pickup_datetime AS DATE) AS trip_date,
       "PULocationID" AS pickup_zone_id, total_amount FROM {table}"""


ZONE_SUMMARY = f"""
SELECT trip_date, pickup_zone_id, count(*) AS trip_count, {_sum('total_amount')} AS total_revenue
FROM zone_trips GROUP BY trip_date, pickup_zone_id
"""


def _broken(rules: TripRules) -> dict[str, str]:
    """Each rule that a trip can break, and when it does."""
    sources = ", ".join(f"'{source}'" for source in rules.sources)
    return {
        "dropoff after pickup": "pickup_datetime >= dropoff_datetime",
        "distance above zero": "trip_distance <= 0",
        "fare not below zero": "fare_amount < 0",
        "total above zero": "total_amount <= 0",
        "pickup zone": f"pickup_location_id NOT {_zone(rules)}",
        "dropoff zone": f"dropoff_location_id NOT {_zone(rules)}",
        "source": f"source_type NOT IN ({sources})",
    }


def _invalid(rules: TripRules) -> str:
    return " OR ".join(_broken(rules).values())


INVALID = _invalid(DEFAULT.rules)
FIRST_BROKEN = "CASE " + " ".join(f"WHEN {broken} THEN '{name}'" for name, broken in _broken(FEWER_ZONES).items()) + " END"

VALIDATED_STREAM = f"SELECT * FROM ({RAW_STREAM}) WHERE NOT coalesce({INVALID}, FALSE)"

REQUIRED = """lpep_pickup_datetime IS NULL OR lpep_dropoff_datetime IS NULL
  OR "PULocationID" IS NULL OR "DOLocationID" IS NULL"""

IN_STREAM = f"pickup_date {_within(DEFAULT.stream_window)} AND source_type = 'stream'"

_STEPS = {
    "raw_batch": RAW_BATCH,
    "raw_stream": RAW_STREAM,
    "window_batch": WINDOW_BATCH,
    "window_stream": WINDOW_STREAM,
    "valid_batch": VALID_BATCH,
    "unified": CONFORM_BATCH + "valid_batch UNION ALL " + CONFORM_STREAM + "window_stream",
    "conformed": CONFORM_BATCH + "raw_batch UNION ALL " + CONFORM_STREAM + "raw_stream",
    "int_trips": _latest("unified"),
    "daily": DAILY,
    "monthly": MONTHLY,
    "zone_trips": _zone_trips("raw_batch"),
    "zone_summary": ZONE_SUMMARY,
}


def _with(final: str, **replaced: str) -> str:
    steps = {**_STEPS, **replaced}
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in steps.items()) + "\n" + final


def _gate(name: str, table: str, observed: str, passes: str, **extra: str) -> str:
    more = "".join(f", '{value}' AS {column}" for column, value in extra.items())
    return f"SELECT '{name}' AS gate, observed, observed {passes} AS passed{more} FROM (SELECT {observed} AS observed FROM {table})"


def _count_if(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"


def _both(name: str, observed: str, passes: str) -> str:
    arrived = _gate(name, "conformed", observed, passes, checked="arrived")
    return arrived + " UNION ALL " + _gate(name, "int_trips", observed, passes, checked="finished")


def _null_test(table: str, column: str, extra: str = "") -> str:
    nulls = _count_if(f'"{column}" IS NULL')
    return (
        f"SELECT 'not_null' AS test, '{column}' AS \"column\", {nulls} AS failures, {nulls} = 0 AS passed{extra} FROM {table}"
    )


def _unique_test(table: str, column: str, extra: str = "") -> str:
    return f"""SELECT 'unique' AS test, '{column}' AS "column", count(*) AS failures, count(*) = 0 AS passed{extra}
FROM (SELECT {column} FROM {table} WHERE {column} IS NOT NULL GROUP BY {column} HAVING count(*) > 1)"""


def _columns_of(table: str) -> str:
    """The names of a table's columns that belong to the trip contract, as rows."""
    names = ", ".join(f"'{name}'" for name in TRIP_SCHEMA.names)
    return f"""(SELECT name FROM (UNPIVOT (SELECT count(COLUMNS(*)) FROM {table}) ON COLUMNS(*) INTO NAME name VALUE n)
WHERE name IN ({names}))"""


def _union(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def all_sql() -> dict[str, str]:
    duplicates = "count(*) - count(DISTINCT trip_id)"
    zone_of = "stg_trips", "daily_trip_summary"
    staged = f", '{zone_of[0]}' AS model"
    summary = f", '{zone_of[1]}' AS model"
    names = TableNames()
    tables = names.batch_staging, names.trips, names.daily_mart
    return {
        "load_batch_staging": _with(
            'SELECT * REPLACE (CAST("PULocationID" AS BIGINT) AS "PULocationID", CAST("DOLocationID" AS BIGINT) AS "DOLocationID"), '
            "CAST(lpep_pickup_datetime AS DATE) AS lpep_pickup_date FROM raw_batch"
        ),
        "replace_table_rerun": _with("SELECT * FROM window_stream"),
        "layout_roundtrip": _with("SELECT * FROM unified"),
        "table_roundtrip": "SELECT count(*) AS row_count, TRUE AS dropped FROM events",
        "conform_batch": _with(CONFORM_BATCH + "raw_batch"),
        "conform_stream": _with(CONFORM_STREAM + "raw_stream"),
        "fingerprint_trips": _with(f"SELECT {DIGEST} AS trip_id, lpep_pickup_datetime, total_amount FROM raw_batch"),
        "window_batch": _with("SELECT * FROM window_batch"),
        "window_stream": _with("SELECT * FROM window_stream"),
        "valid_batch": _with("SELECT * FROM valid_batch"),
        "unified_trips": _with("SELECT * FROM unified"),
        "dedup_latest": _with(_latest("conformed")),
        "int_trips": _with("SELECT * FROM int_trips"),
        "mart_daily": _with("SELECT * FROM daily"),
        "mart_monthly": _with("SELECT * FROM monthly"),
        "daily_zone_summary": _with("SELECT * FROM zone_summary"),
        "zone_summary_run": _with("SELECT * FROM zone_summary", zone_trips=_zone_trips("valid_batch")),
        "zone_models_run": _with(
            "SELECT * FROM zone_summary",
            zone_trips="SELECT trip_id, pickup_date AS trip_date, pickup_location_id AS pickup_zone_id, total_amount FROM int_trips",
        ),
        "check_batch_row_count": _with(_gate("check_batch_row_count", "raw_batch", "count(*)", "> 0")),
        "check_required_nulls": _with(
            _gate("check_batch_required_nulls", "raw_batch", _count_if(REQUIRED), "= 0")
        ),
        "check_required_schema": _with(
            _union(
                _gate("check_required_schema", _columns_of("raw_stream"), "count(*)", "= 15", checked="arrived"),
                _gate("check_required_schema", _columns_of("int_trips"), "count(*)", "= 15", checked="finished"),
            )
        ),
        "check_invalid_values": _with(_both("check_invalid_values", _count_if(INVALID), "= 0")),
        "check_duplicates": _with(_both("check_duplicates", duplicates, "= 0")),
        "check_stream_exists": _with(_gate("check_stream_data_exists", "raw_stream", _count_if(IN_STREAM), "> 0")),
        "check_mart_row_count": _with(_gate("check_mart_row_count", "daily", "count(*)", "> 0")),
        "assert_summary": _with("""
SELECT CAST(0 AS INTEGER) AS "position", 'no rows in daily_trip_summary' AS message, count(*) > 0 AS holds
FROM zone_summary
UNION ALL SELECT CAST(1 AS INTEGER), 'a summary row without trips or with negative revenue',
  count(*) FILTER (WHERE trip_count <= 0 OR total_revenue < 0) = 0 FROM zone_summary"""),
        "test_not_null": _with(
            _union(
                *(
                    _null_test("raw_batch", c)
                    for c in ("lpep_pickup_datetime", "PULocationID", "passenger_count", "total_amount")
                )
            )
        ),
        "test_unique": _with(
            _union(
                _unique_test("unified", "trip_id", ", 'arrived' AS checked"),
                _unique_test("int_trips", "trip_id", ", 'finished' AS checked"),
            )
        ),
        "test_declared": _with(
            _union(
                _unique_test("zone_trips", "trip_id", staged),
                *(_null_test("zone_trips", c, staged) for c in ("trip_id", "trip_date", "total_amount")),
                *(_null_test("zone_summary", c, summary) for c in ("trip_date", "pickup_zone_id", "trip_count")),
            )
        ),
        "test_relationships": _with("""
SELECT "PULocationID" AS missing_key, count(*) AS child_rows FROM raw_batch b
WHERE NOT EXISTS (SELECT 1 FROM raw_stream s WHERE s.pickup_location_id = b."PULocationID")
  AND "PULocationID" IS NOT NULL
GROUP BY 1"""),
        "incremental_trips": _with("SELECT * FROM int_trips", raw_stream=VALIDATED_STREAM),
        "incremental_trip_marts": _with("SELECT * FROM daily", raw_stream=VALIDATED_STREAM),
        "incremental_daily": _with("SELECT * FROM daily"),
        "incremental_monthly": _with("SELECT * FROM monthly"),
        "fractional_amounts": _with(
            f'SELECT "PULocationID", {_sum("share")} AS total_share, {_mean("share")} AS average_share '
            'FROM (SELECT "PULocationID", total_amount / 7 AS share FROM raw_batch) GROUP BY 1'
        ),
        "stream_ingest": _with("SELECT * FROM raw_stream"),
        "stream_ingest_validated": _with("SELECT * FROM raw_stream", raw_stream=VALIDATED_STREAM),
        "stream_rejected": _with(f"SELECT *, {FIRST_BROKEN} AS broken_rule FROM ({RAW_STREAM}) WHERE coalesce({_invalid(FEWER_ZONES)}, FALSE)"),
        "gated_publish": _with(
            _union(
                _gate("check_batch_row_count", "raw_batch", "count(*)", "> 0", table_name=tables[0]),
                _gate("check_batch_required_nulls", "raw_batch", _count_if(REQUIRED), "= 0", table_name=tables[0]),
                _gate("check_required_schema", _columns_of("int_trips"), "count(*)", "= 15", table_name=tables[1]),
                _gate("check_invalid_values", "int_trips", _count_if(INVALID), "= 0", table_name=tables[1]),
                _gate("check_duplicates", "int_trips", duplicates, "= 0", table_name=tables[1]),
                _gate("check_stream_data_exists", "raw_stream", _count_if(IN_STREAM), "> 0", table_name=names.stream_staging),
                _gate("check_mart_row_count", "daily", "count(*)", "> 0", table_name=tables[2]),
                _gate("check_mart_row_count", "monthly", "count(*)", "> 0", table_name=names.monthly_mart),
            ),
            raw_stream=VALIDATED_STREAM,
        ),
        "published_daily_mart": _with("SELECT * FROM daily", raw_stream=VALIDATED_STREAM),
        "published_monthly_mart": _with("SELECT * FROM monthly", raw_stream=VALIDATED_STREAM),
    }
