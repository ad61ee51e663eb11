"""URL filters by a temporal list join.

A list is a log of dated entries (list, pattern, add or remove). Each addition becomes a
validity interval that ends at the next entry of the same list and pattern. A capture is
evaluated as of its fetch time against the entries active then: its host, every parent
domain of two labels or more, and host plus first path segment are equi-joined with the
patterns inside buckets of time, so a long history meets each capture only near its own
time. The longest active pattern decides; at equal length "allow" beats "block".

Only DataFrame functions are used. Intervals are broadcast while their number stays
under ``broadcast_rows``; beyond that both sides are shuffled and captures are salted, so
a hot host is spread.

Edge cases: a null or malformed url has an empty host, and a null fetch time meets no
interval: both give "none"; additions and removals at one instant count as a removal;
repeated rows and extra columns are kept, but a column called like a new one is replaced;
an empty list or capture table works.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
STEP_US = 7 * 86_400_000_000  # width of a time bucket


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session's zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))


def segment_of(url: Column) -> Column:
    """First path segment."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1)


def suffixes(host: Column) -> Column:
    """The host and its parent domains down to two labels."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, n), "."))).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, action, at in micros) -> (list, pattern, since, until); until is null while open."""
    once = entries.where(F.col("at").isNotNull() & F.col("pattern").isNotNull()).groupBy("list", "pattern", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "pattern").orderBy("at")
    return once.withColumn("until", F.lead("at").over(w)).where(F.col("action") == "add").select("list", "pattern", F.col("at").alias("since"), "until")


def filter_captures(captures: DataFrame, entries: DataFrame, url_col: str = "url", at_col: str = "fetched_us", broadcast_rows: int = 100_000) -> DataFrame:
    """The captures with host, n_active, pattern, since_us and verdict ("block", "allow" or "none")."""
    keyed = captures.withColumns({"__host": host_of(F.col(url_col)), "__seg": segment_of(F.col(url_col)), "__at": F.col(at_col)})
    span = keyed.agg(F.min("__at").alias("lo"), F.max("__at").alias("hi")).first()
    low, high = span["lo"] or 0, span["hi"] or 0
    bucket = lambda c: F.floor(c / F.lit(STEP_US)).cast("long")
    intervals = (
        validity_intervals(entries)
        .where((F.col("since") <= high) & (F.coalesce("until", F.lit(high + 1)) > low))
        .withColumn("__b", F.explode(F.sequence(bucket(F.greatest("since", F.lit(low))), bucket(F.least(F.coalesce("until", F.lit(high)), F.lit(high))))))
    )
    # one row for each place and time that has captures; repeated captures are evaluated once
    asked = keyed.where(F.col("__at").isNotNull() & (F.col("__host") != "")).groupBy("__host", "__seg", "__at").agg(F.count("*").alias("__copies"))
    wanted = F.concat(suffixes(F.col("__host")), F.when(F.col("__seg") != "", F.array(F.concat_ws("/", "__host", "__seg"))).otherwise(F.array().cast("array<string>")))
    asked = asked.withColumn("pattern", F.explode(wanted)).withColumn("__b", bucket(F.col("__at")))
    small = intervals.limit(broadcast_rows + 1).count() <= broadcast_rows
    if small:
        joined = asked.join(F.broadcast(intervals), ["pattern", "__b"])
    else:
        asked = asked.withColumn("__salt", F.pmod(F.xxhash64("__host", "__seg", "__at"), F.lit(SALTS)))
        intervals = intervals.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = asked.join(intervals, ["pattern", "__b", "__salt"])
    active = joined.where((F.col("since") <= F.col("__at")) & (F.coalesce("until", F.lit(high + 1)) > F.col("__at")))
    # the longest pattern, then "allow", then the latest addition
    best = F.max(F.struct(F.length("pattern").alias("n"), (F.col("list") == "allow").alias("allow"), "since", "pattern", "list"))
    verdicts = active.groupBy("__host", "__seg", "__at").agg(F.count("*").alias("n_active"), best.alias("__best"))
    return (
        keyed.join(verdicts, ["__host", "__seg", "__at"], "left")
        .select(
            *(keyed[c] for c in captures.columns if c.lower() not in ("host", "n_active", "pattern", "since_us", "verdict")),
            F.col("__host").alias("host"),
            F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
            F.col("__best.pattern").alias("pattern"),
            F.col("__best.since").alias("since_us"),
            F.coalesce(F.col("__best.list"), F.lit("none")).alias("verdict"),
        )
    )


def _digit(pattern: Column, at: int) -> Column:
    """Two hexadecimal digits of the pattern's md5 as a number."""
    return F.conv(F.substring(F.md5(pattern), at, 2), 16, 10).cast("long")


def derived_entries(places: DataFrame) -> DataFrame:
    """A dated list over the hosts and first path segments of a crawl: which patterns, on which list and when follows from their md5."""
    p = F.col("pattern")
    day, hour = F.lit(86_400_000_000), F.lit(3_600_000_000)
    start = micros(F.lit("2024-01-01 00:00:00")) + (_digit(p, 1) % 20) * day + (_digit(p, 11) % 24) * hour
    patterns = F.concat(suffixes(F.col("host")), F.when(F.col("seg") != "", F.array(F.concat_ws("/", "host", "seg"))).otherwise(F.array().cast("array<string>")))
    listed = places.select(F.explode(patterns).alias("pattern")).distinct().where(_digit(p, 9) % F.when(p.contains("/"), 24).otherwise(3) == 0)
    stop = start + (1 + _digit(p, 3) % 6) * day
    again = stop + (1 + _digit(p, 5) % 6) * day
    rows = [F.struct(F.lit("add").alias("action"), start.alias("at")), F.struct(F.lit("remove").alias("action"), stop.alias("at"))]
    rows = F.when(_digit(p, 7) % 2 == 0, F.array(*rows, F.struct(F.lit("add").alias("action"), again.alias("at")))).otherwise(F.array(*rows))
    return listed.select(F.when(_digit(p, 13) % 4 == 0, F.lit("allow")).otherwise(F.lit("block")).alias("list"), "pattern", F.explode(rows).alias("e")).select("list", "pattern", "e.*")


def op5_urlfilter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("page_id"), micros("ts").alias("ts_us"))
    fallback = micros(F.lit("2024-01-01 00:00:00")) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(30)) * F.lit(86_400_000_000)
    captures = pages.join(events, "page_id", "left").select("page_id", "url", F.coalesce("ts_us", fallback).alias("fetched_us"))
    places = pages.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("seg")).where("host <> ''").distinct()
    return filter_captures(captures, derived_entries(places)).drop("url")


OP5_SQL = r"""
with captures as (
  select page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) as host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) as seg,
         coalesce(epoch_us(ts), epoch_us(timestamp '2024-01-01') + (page_id % 30) * 86400000000) as fetched_us
  from pages left join events on event_id = page_id),
wanted as (
  select page_id, host, fetched_us, unnest([array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')))]
         || case when host <> '' and seg <> '' then [host || '/' || seg] else [] end) as pattern from captures),
patterns as (select distinct pattern from wanted),
h as (
  select pattern, md5(pattern) as m from patterns),
d as (
  select pattern, ('0x' || m[1:2])::int as d1, ('0x' || m[3:4])::int as d3, ('0x' || m[5:6])::int as d5, ('0x' || m[7:8])::int as d7,
         ('0x' || m[9:10])::int as d9, ('0x' || m[11:12])::int as d11, ('0x' || m[13:14])::int as d13 from h),
s as (
  select pattern, case when d13 % 4 = 0 then 'allow' else 'block' end as list,
         epoch_us(timestamp '2024-01-01') + (d1 % 20)::bigint * 86400000000 + (d11 % 24)::bigint * 3600000000 as start,
         (1 + d3 % 6)::bigint * 86400000000 as len, (1 + d5 % 6)::bigint * 86400000000 as gap, d7 from d where d9 % (case when contains(pattern, '/') then 24 else 3 end) = 0),
intervals as (
  select list, pattern, start as since, start + len as until from s
  union all select list, pattern, start + len + gap, null from s where d7 % 2 = 0),
hits as (
  select w.page_id, i.*, row_number() over (partition by w.page_id order by length(i.pattern) desc, i.list, i.since desc) as rn,
         count(*) over (partition by w.page_id) as n
  from wanted w join intervals i on i.pattern = w.pattern and i.since <= w.fetched_us and (i.until is null or i.until > w.fetched_us))
select c.page_id, c.fetched_us, c.host, coalesce(h.n, 0) as n_active, h.pattern, h.since as since_us, coalesce(h.list, 'none') as verdict
from captures c left join hits h on h.page_id = c.page_id and h.rn = 1
"""
