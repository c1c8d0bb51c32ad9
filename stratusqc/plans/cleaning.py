"""Queries of sources, cleaning and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratusqc import adapters as A
from stratusqc.constants import DAILY_FIELDS, SERIES_DECIMALS, VARIABLES
from stratusqc.functions.cleaning import lenient_double, lenient_timestamp
from stratusqc.operators import qc as Q
from stratusqc.plans import oracle as O
from stratusqc.plans.registry import query, stamp
from stratusqc.session import scratch_dir
from stratusqc.sources import ingest as I
from stratusqc.sources import readers as RD
from stratusqc.sources import sinks as SK

# Raw file rows made from events: untidy headers, several time formats, missing tokens, bad numbers.
_RAW = """
raw AS (
  SELECT event_id,
    CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'XX9'
         WHEN event_id % 3 = 0 THEN ' st' || user_id || ' ' WHEN event_id % 7 = 0 THEN CAST(user_id AS VARCHAR)
         ELSE 'ST' || user_id END AS st,
    CASE event_id % 7 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
         WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M') WHEN 3 THEN strftime(ts, '%d-%m-%Y %H:%M:%S')
         WHEN 4 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') WHEN 5 THEN strftime(ts, '%Y/%m/%d %H:%M') ELSE 'someday' END AS tm,
    CASE event_id % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN '' WHEN 2 THEN 'bad' ELSE CAST(value AS VARCHAR) END AS temp_c,
    CASE event_id % 4 WHEN 0 THEN 'null' ELSE ' ' || CAST(value AS VARCHAR) || ' ' END AS air_temp,
    CAST(value * 2 - 20 AS VARCHAR) AS rh,
    CAST(round(value * 3, 2) AS VARCHAR) AS wdir,
    ts, user_id, value
  FROM events),
harmonized AS (
  SELECT event_id, CASE WHEN st NOT IN ('', 'null', 'NaN', 'nan') THEN st END AS station_code, tm AS "timestamp",
    coalesce(CASE WHEN temp_c NOT IN ('', 'null', 'NaN', 'nan') THEN temp_c END,
             CASE WHEN air_temp NOT IN ('', 'null', 'NaN', 'nan') THEN air_temp END) AS temperature,
    rh AS humidity, wdir AS wind_direction, user_id
  FROM raw),
typed AS (
  SELECT event_id, station_code, TRY_CAST(trim(temperature) AS DOUBLE) AS temperature,
    TRY_CAST(humidity AS DOUBLE) AS humidity, TRY_CAST(wind_direction AS DOUBLE) AS wind_direction,
    coalesce(try_strptime("timestamp", '%Y-%m-%dT%H:%M:%SZ'), try_strptime("timestamp", '%Y-%m-%d %H:%M:%S'),
             try_strptime("timestamp", '%Y-%m-%d %H:%M'), try_strptime("timestamp", '%d-%m-%Y %H:%M:%S'),
             try_strptime("timestamp", '%d/%m/%Y %H:%M:%S'), try_strptime("timestamp", '%Y/%m/%d %H:%M')) AS ts
  FROM harmonized)"""


def raw_rows(spark, sf):
    eid, uid, ts, value = F.col("event_id"), F.col("user_id").cast("string"), F.col("ts"), F.col("value")
    st = (
        F.when(eid % 11 == 0, F.lit(None).cast("string"))
        .when(eid % 13 == 0, "XX9")
        .when(eid % 3 == 0, F.concat(F.lit(" st"), uid, F.lit(" ")))
        .when(eid % 7 == 0, uid)
        .otherwise(F.concat(F.lit("ST"), uid))
    )
    formats = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "dd-MM-yyyy HH:mm:ss",
               "dd/MM/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm"]
    tm = F.lit("someday")
    for i, f in enumerate(formats):
        tm = F.when(eid % 7 == i, F.date_format(ts, f)).otherwise(tm)
    text = value.cast("string")
    return A.events(spark, sf).select(
        "event_id",
        st.alias(" Station_ID "),
        tm.alias("Time"),
        F.when(eid % 5 == 0, "NaN").when(eid % 5 == 1, "").when(eid % 5 == 2, "bad").otherwise(text).alias("TEMP_C"),
        F.when(eid % 4 == 0, "null").otherwise(F.concat(F.lit(" "), text, F.lit(" "))).alias("air_temp"),
        (value * 2 - 20).cast("string").alias("RH"),
        F.round(value * 3, 2).cast("string").alias("wdir"),
    )


def typed_rows(spark, sf):
    return RD.typed_readings(RD.harmonize_columns(raw_rows(spark, sf), keep=("event_id",)), keep=("event_id",))


_RAWQ = O.with_(_RAW)


@query(
    "harmonize_columns",
    _RAWQ + 'SELECT event_id, station_code, "timestamp" AS time_text, temperature, humidity, wind_direction FROM harmonized',
)
def harmonize_columns(spark, sf):
    return RD.harmonize_columns(raw_rows(spark, sf), keep=("event_id",)).select(
        "event_id", "station_code", F.col("timestamp").alias("time_text"), "temperature", "humidity", "wind_direction"
    )


@query("lenient_cast", _RAWQ + "SELECT event_id, temperature, round(humidity, 6) AS humidity FROM typed")
def lenient_cast(spark, sf):
    h = RD.harmonize_columns(raw_rows(spark, sf), keep=("event_id",))
    return h.select(
        "event_id",
        lenient_double(F.col("temperature")).alias("temperature"),
        F.round(lenient_double(F.col("humidity")), 6).alias("humidity"),
    )


@query("parse_timestamps", _RAWQ + f"SELECT event_id, {O.stamp('ts')} AS ts, ts IS NULL AS rejected FROM typed")
def parse_timestamps(spark, sf):
    h = RD.harmonize_columns(raw_rows(spark, sf), keep=("event_id",))
    ts = lenient_timestamp(F.col("timestamp"))
    return h.select("event_id", stamp(ts).alias("ts"), ts.isNull().alias("rejected"))


@query(
    "clamp_humidity",
    _RAWQ + "SELECT event_id, round(CASE WHEN humidity IS NOT NULL THEN greatest(0.0, least(100.0, humidity)) END, 6) AS humidity FROM typed",
)
def clamp_humidity(spark, sf):
    return I.clamp_humidity(typed_rows(spark, sf)).select("event_id", F.round("humidity", 6).alias("humidity"))


@query(
    "validate_readings",
    _RAWQ
    + """SELECT coalesce(CASE WHEN ts IS NULL THEN 'timestamp_invalid' WHEN humidity < 0 OR humidity > 100 THEN 'humidity_out_of_bounds'
           WHEN wind_direction < 0 OR wind_direction > 360 THEN 'wind_direction_out_of_bounds' END, 'accepted') AS outcome,
         count(*) AS n FROM typed GROUP BY 1""",
)
def validate_readings(spark, sf):
    ok, rejected = I.validate_readings(typed_rows(spark, sf))
    both = ok.select(F.lit("accepted").alias("outcome")).unionByName(rejected.select(F.col("reason").alias("outcome")))
    return both.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_RESOLVE = """
names AS (SELECT station_code AS name, station_id, 0 AS p FROM stations
          UNION ALL SELECT CAST(station_id AS VARCHAR), station_id, 1 FROM stations)"""


@query(
    "resolve_station",
    O.with_(_RAW, O.STATIONS, _RESOLVE)
    + "SELECT event_id, n.station_id FROM typed t JOIN names n ON trim(t.station_code) = n.name",
)
def resolve_station(spark, sf):
    known, _ = I.resolve_station(typed_rows(spark, sf), A.stations(spark, sf))
    return known.select("event_id", "station_id")


@query(
    "resolve_station_unknown",
    O.with_(_RAW, O.STATIONS, _RESOLVE)
    + """SELECT event_id, station_code FROM typed t
         WHERE NOT EXISTS (SELECT 1 FROM names n WHERE trim(t.station_code) = n.name)""",
)
def resolve_station_unknown(spark, sf):
    _, unknown = I.resolve_station(typed_rows(spark, sf), A.stations(spark, sf))
    return unknown.select("event_id", "station_code")


@query(
    "resolve_with_default",
    O.with_(_RAW, O.STATIONS, _RESOLVE)
    + """SELECT event_id, coalesce(n.station_id, 1) AS station_id FROM typed t
         LEFT JOIN names n ON upper(trim(t.station_code)) = n.name""",
)
def resolve_with_default(spark, sf):
    known, _ = I.resolve_with_default(typed_rows(spark, sf), A.stations(spark, sf), "st1")
    return known.select("event_id", "station_id")


# A batch with repeats: events by station and hour; the first half of the month is already stored.
_BATCH = """
batch AS (SELECT event_id, user_id AS station_id, date_trunc('hour', ts) AS ts, value FROM events),
stored AS (SELECT DISTINCT station_id, ts FROM batch WHERE ts < TIMESTAMP '2024-01-16 00:00:00'),
accepted AS (
  SELECT * FROM batch b WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.station_id = b.station_id AND s.ts = b.ts)
  QUALIFY row_number() OVER (PARTITION BY station_id, ts ORDER BY event_id) = 1)"""


def hourly_batch(spark, sf):
    return A.events(spark, sf).select(
        "event_id", F.col("user_id").alias("station_id"), F.date_trunc("hour", "ts").alias("ts"), "value"
    )


def stored_keys(spark, sf):
    return hourly_batch(spark, sf).filter("ts < timestamp'2024-01-16 00:00:00'").select("station_id", "ts").distinct()


@query("dedup_readings", O.with_(_BATCH) + f"SELECT event_id, station_id, {O.stamp('ts')} AS ts FROM accepted")
def dedup_readings(spark, sf):
    return I.dedup_readings(hourly_batch(spark, sf), stored_keys(spark, sf), ["event_id"]).select(
        "event_id", "station_id", stamp("ts").alias("ts")
    )


@query(
    "new_only",
    O.with_(_BATCH)
    + "SELECT event_id FROM batch b WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.station_id = b.station_id AND s.ts = b.ts)",
)
def new_only(spark, sf):
    return I.new_only(hourly_batch(spark, sf), stored_keys(spark, sf), ["station_id", "ts"]).select("event_id")


@query(
    "members_only",
    O.with_(O.READINGS, O.STATIONS)
    + "SELECT reading_id FROM readings WHERE station_id IN (SELECT station_id FROM stations WHERE state = 'State 3')",
)
def members_only(spark, sf):
    ids = A.stations(spark, sf).filter("state = 'State 3'")
    return I.members_only(A.readings(spark, sf), ids).select("reading_id")


_JUDGED = _BATCH + """,
judged AS (
  SELECT event_id, CASE WHEN value >= 90 THEN 'anomalous' WHEN value >= 60 THEN 'suspect' ELSE 'valid' END AS verdict FROM accepted)"""


def judged_batch(spark, sf):
    accepted = I.dedup_readings(hourly_batch(spark, sf), stored_keys(spark, sf), ["event_id"]).withColumn(
        "reading_id", F.col("event_id")
    )
    rolled = Q.reading_rollup(A.verdicts(spark, sf))
    return accepted, rolled.join(accepted.select("reading_id"), "reading_id", "left_semi")


@query(
    "ingest_summary",
    O.with_(_JUDGED)
    + """SELECT (SELECT count(*) FROM batch) AS received, (SELECT count(*) FROM accepted) AS ingested,
         (SELECT count(*) FROM batch) - (SELECT count(*) FROM accepted) AS duplicates,
         (SELECT count(*) FROM judged WHERE verdict = 'anomalous') AS anomalies,
         (SELECT count(DISTINCT station_id) FROM accepted) AS stations_affected""",
)
def ingest_summary(spark, sf):
    accepted, rolled = judged_batch(spark, sf)
    return I.ingest_summary(hourly_batch(spark, sf), accepted, rolled)


@query("stations_affected", O.with_(_BATCH) + "SELECT DISTINCT station_id FROM accepted")
def stations_affected(spark, sf):
    accepted, _ = judged_batch(spark, sf)
    return I.stations_affected(accepted)


@query(
    "ingest_preview",
    O.with_(_JUDGED)
    + """SELECT b.event_id, CASE WHEN a.event_id IS NULL THEN 'duplicate_skipped' ELSE j.verdict END AS qc_verdict
         FROM (SELECT * FROM batch ORDER BY event_id LIMIT 15) b LEFT JOIN accepted a USING (event_id) LEFT JOIN judged j USING (event_id)""",
)
def ingest_preview(spark, sf):
    accepted, rolled = judged_batch(spark, sf)
    return I.ingest_preview(hourly_batch(spark, sf), accepted, rolled, "event_id").select("event_id", "qc_verdict")


@query(
    "normalize_hourly_feed",
    """SELECT l_orderkey, l_linenumber, round(l_quantity, 6) AS temperature, round(l_extendedprice / 3.6, 6) AS wind_speed,
         strftime(l_shipdate - INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') AS ts, CAST(NULL AS DOUBLE) AS solar_radiation
       FROM lineitem""",
)
def normalize_hourly_feed(spark, sf):
    feed = A.table(spark, sf, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber").alias("key"),
        F.col("l_shipdate").cast("timestamp").alias("time"),
        F.col("l_quantity").alias("temp"),
        F.col("l_discount").alias("rhum"),
        F.col("l_tax").alias("pres"),
        F.col("l_extendedprice").alias("wspd"),
    )
    return RD.normalize_hourly_feed(feed, F.col("key"), "Asia/Kolkata").select(
        F.col("station_code.l_orderkey").alias("l_orderkey"),
        F.col("station_code.l_linenumber").alias("l_linenumber"),
        F.round("temperature", 6).alias("temperature"),
        F.round("wind_speed", 6).alias("wind_speed"),
        stamp("ts").alias("ts"),
        "solar_radiation",
    )


def _array(fn):
    return F.transform("embedding", lambda x: fn(x.cast("double")))


_SERIES_SQL = ", ".join(
    f"round_even(CAST(round(CAST(embedding[i + 1] AS DOUBLE) * {k + 3}, 9) AS DECIMAL(18, 9)), {SERIES_DECIMALS[v]})::DOUBLE AS {v}"
    for k, v in enumerate(VARIABLES)
)


@query(
    "zip_series_to_rows",
    f"""SELECT vec_id AS station_id, strftime(TIMESTAMP '2024-03-01 00:00:00' + to_hours(vec_id) + to_minutes(i * 15), '%Y-%m-%d %H:%M:%S') AS ts, {_SERIES_SQL}
        FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)""",
)
def zip_series_to_rows(spark, sf):
    start = F.lit(1709251200) + F.col("vec_id") * 3600
    series = A.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("station_id"),
        F.timestamp_seconds(start).alias("start"),
        F.timestamp_seconds(start + F.size("embedding") * 900).alias("end"),
        F.lit(900).alias("step"),
        *[_array(lambda x: F.round(x * (k + 3), 9)).alias(v) for k, v in enumerate(VARIABLES)],
    )
    return RD.zip_series_to_rows(series).withColumn("ts", stamp("ts"))


@query(
    "daily_series_to_rows",
    """SELECT vec_id AS station_id, strftime(DATE '2024-03-01' + CAST(i AS INTEGER), '%Y-%m-%d') AS day, """
    + ", ".join(f"round(CAST(embedding[i + 1] AS DOUBLE) + {k}, 6) AS {f}" for k, f in enumerate(DAILY_FIELDS))
    + " FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)",
)
def daily_series_to_rows(spark, sf):
    start = F.lit(1709251200)
    series = A.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("station_id"),
        F.timestamp_seconds(start).alias("start"),
        F.timestamp_seconds(start + F.size("embedding") * 86400).alias("end"),
        F.lit(86400).alias("step"),
        *[_array(lambda x: x + k).alias(f) for k, f in enumerate(DAILY_FIELDS)],
    )
    return RD.daily_series_to_rows(series).select(
        "station_id", F.date_format("date", "yyyy-MM-dd").alias("day"), *[F.round(f, 6).alias(f) for f in DAILY_FIELDS]
    )


@query(
    "union_station_frames",
    """SELECT variable, count(*) AS n, count(extra) AS n_extra, min(event_id) AS first_id FROM (
         SELECT event_type AS variable, event_id, NULL AS extra FROM events WHERE event_type <> 'error'
         UNION ALL SELECT event_type, event_id, value FROM events WHERE event_type = 'error') GROUP BY 1""",
)
def union_station_frames(spark, sf):
    base = A.events(spark, sf).select(F.col("event_type").alias("variable"), "event_id", "value")
    stacked = RD.union_frames(
        base.filter("variable <> 'error'").drop("value"),
        base.filter("variable = 'error'").withColumnRenamed("value", "extra"),
    )
    return stacked.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.count("extra").alias("n_extra"), F.min("event_id").alias("first_id")
    )


@query(
    "missing_profile",
    O.with_(O.READINGS)
    + " UNION ALL ".join(
        f"SELECT '{v}' AS column_name, count(*) - count({v}) AS missing, count(*) AS rows, count(DISTINCT station_id) AS stations FROM readings"
        for v in VARIABLES
    ),
)
def missing_profile(spark, sf):
    return I.missing_profile(A.readings(spark, sf))


_LISTS = """
current_list AS (SELECT station_code, name, latitude FROM stations WHERE station_id % 2 = 0),
file_list AS (SELECT station_code, name || ' (file)' AS name, latitude + 0.5 AS latitude FROM stations WHERE station_id % 3 = 0),
builtin_list AS (SELECT station_code, name || ' (built in)' AS name, latitude FROM stations WHERE station_id % 5 <> 1)"""


def station_lists(spark, sf):
    s = A.stations(spark, sf)
    current = s.filter("station_id % 2 = 0").select("station_code", "name", "latitude")
    file = s.filter("station_id % 3 = 0").select(
        "station_code", F.concat("name", F.lit(" (file)")).alias("name"), (F.col("latitude") + 0.5).alias("latitude")
    )
    builtin = s.filter("station_id % 5 <> 1").select(
        "station_code", F.concat("name", F.lit(" (built in)")).alias("name"), "latitude"
    )
    return current, file, builtin


@query(
    "upsert_stations",
    O.with_(O.STATIONS, _LISTS)
    + """, incoming AS (SELECT * FROM file_list UNION ALL SELECT * FROM builtin_list WHERE station_code NOT IN (SELECT station_code FROM file_list))
         SELECT coalesce(i.station_code, c.station_code) AS station_code, coalesce(i.name, c.name) AS name,
           round(coalesce(i.latitude, c.latitude), 6) AS latitude,
           CASE WHEN c.station_code IS NULL THEN 'insert' WHEN i.station_code IS NULL THEN 'keep' ELSE 'update' END AS action
         FROM current_list c FULL JOIN incoming i ON c.station_code = i.station_code""",
)
def upsert_stations(spark, sf):
    return I.upsert_stations(*station_lists(spark, sf)).withColumn("latitude", F.round("latitude", 6))


@query(
    "codes_missing",
    O.with_(O.STATIONS, _LISTS)
    + "SELECT station_code FROM builtin_list WHERE station_code NOT IN (SELECT station_code FROM current_list)",
)
def codes_missing(spark, sf):
    current, _, builtin = station_lists(spark, sf)
    return I.codes_missing(current, builtin).select("station_code")


@query(
    "upload_log",
    """SELECT 'events.parquet' AS filename, 'parquet' AS file_type, 'completed' AS status,
         count(DISTINCT (user_id, date_trunc('day', ts))) AS records_processed,
         count(*) - count(DISTINCT (user_id, date_trunc('day', ts))) AS records_failed FROM events""",
)
def upload_log(spark, sf):
    """One reading per station and day is taken, later ones count as failed."""
    events = A.table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    return I.upload_log(events, ["user_id", "day"], "event_id").drop("file_size")


@query(
    "read_readings_csv",
    O.with_(_RAW)
    + f"SELECT count(*) AS n, count(temperature) AS n_temperature, count(ts) AS n_ts, round(sum(temperature), 4) AS total, min({O.stamp('ts')}) AS first_ts FROM typed",
)
def read_readings_csv(spark, sf):
    """Writes the raw rows as CSV into the shared folder and reads them back through the reader."""
    path = scratch_dir(spark, "csv")
    raw = raw_rows(spark, sf)
    # Two uploads whose files order their columns differently.
    half = F.pmod(F.xxhash64(*raw.columns), F.lit(2)) == 0
    SK.write_csv(raw.filter(half), f"{path}/a")
    SK.write_csv(raw.filter(~half).select(*reversed(raw.columns)), f"{path}/b")
    rows = RD.typed_readings(RD.harmonize_columns(RD.read_readings_csv(spark, [f"{path}/a", f"{path}/b"])))
    return _file_counts(rows)


def _file_counts(rows):
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("temperature").alias("n_temperature"),
        F.count("ts").alias("n_ts"),
        F.round(F.sum("temperature"), 4).alias("total"),
        F.min(stamp("ts")).alias("first_ts"),
    )


@query(
    "read_readings_json",
    O.with_(_RAW)
    + f"SELECT count(*) AS n, count(temperature) AS n_temperature, count(ts) AS n_ts, round(sum(temperature), 4) AS total, min({O.stamp('ts')}) AS first_ts FROM typed",
)
def read_readings_json(spark, sf):
    """Uploads of three layouts: lines, one array a file, an object with ``readings``; 10,000 rows a file at most."""
    path = scratch_dir(spark, "json")
    raw = raw_rows(spark, sf).withColumn("_id", F.monotonically_increasing_id())
    layout = F.pmod(F.xxhash64(*raw.drop("_id").columns), F.lit(3))
    raw.filter(layout == 0).drop("_id").write.json(f"{path}/lines")
    upload = F.floor(F.col("_id") / 10_000).alias("upload")
    rows = F.collect_list(F.struct(*raw.drop("_id").columns))
    for kind, name, value in ((1, "arrays", rows), (2, "objects", F.struct(F.lit("upload").alias("kind"), rows.alias("readings")))):
        files = raw.filter(layout == kind).groupBy(upload).agg(F.to_json(value).alias("value"))
        files.write.partitionBy("upload").text(f"{path}/{name}")
    lines = RD.read_readings_json(spark, f"{path}/lines", lines=True)
    files = RD.read_readings_json(spark, [f"{path}/arrays", f"{path}/objects"])
    return _file_counts(RD.typed_readings(RD.harmonize_map(lines.unionByName(files))))


@query(
    "write_results",
    O.with_(O.VERDICTS)
    + "SELECT strftime(created_at, '%Y-%m-%d') AS day, verdict, count(*) AS n FROM verdicts GROUP BY 1, 2",
)
def write_results(spark, sf):
    """Appends verdict rows to date-partitioned Parquet in the shared folder and counts them there."""
    path = scratch_dir(spark, "results")
    SK.write_results(A.verdicts(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "verdict").agg(F.count(F.lit(1)).alias("n"))
