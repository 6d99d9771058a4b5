"""Queries over time codes, intervals and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.functions import timecode as tc
from mnemospark.operators import intervals, windows
from mnemospark.plans.registry import query
from mnemospark.plans.tables import EVENTS_SQL, clock_events, table

_CLOCK = lambda s: f"(lpad(({s} // 3600)::VARCHAR, 2, '0') || lpad(({s} // 60 % 60)::VARCHAR, 2, '0') || lpad(({s} % 60)::VARCHAR, 2, '0'))"
_CODE = f"(d::VARCHAR || {_CLOCK('sec')} || lpad(ff::VARCHAR, 2, '0'))::BIGINT"


def _captions(spark, sf_dir, length=30):
    """Events as captions: a code, and a span of length seconds since day 0."""
    e = clock_events(spark, sf_dir)
    clock = F.concat(F.substring(tc.seconds_clock(F.col("sec")), 1, 6), F.lpad(F.col("ff").cast("string"), 2, "0"))
    return e.select("event_id", "user_id", "event_type", "value", "d", "sec", tc.time_code(F.concat(F.lit("DAY"), F.col("d").cast("string")), clock).alias("code"), (F.col("d") * 86400 + F.col("sec")).alias("start_s"), (F.col("d") * 86400 + F.col("sec") + length).alias("end_s"))


_CAPTIONS = f"""{EVENTS_SQL}, cap AS (
  SELECT event_id, user_id, event_type, value, d, sec, {_CODE} AS code, d * 86400 + sec AS start_s, d * 86400 + sec + 30 AS end_s FROM ev)"""


@query(
    "timecode_encode_decode",
    f"""WITH {_CAPTIONS} SELECT event_id, code, d * 86400 + sec AS total_s, sec AS day_s,
    {_CLOCK('(sec + 90)')} || '00' AS later_clock,
    'DAY' || d::VARCHAR || ' ' || lpad((sec // 3600)::VARCHAR, 2, '0') || ':' || lpad((sec // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((sec % 60)::VARCHAR, 2, '0') AS shown
    FROM cap""",
)
def timecode_encode_decode(spark, sf_dir):
    c = _captions(spark, sf_dir)
    return c.select("event_id", "code", tc.code_total_seconds(F.col("code")).alias("total_s"), tc.code_seconds(F.col("code")).alias("day_s"), tc.seconds_clock(F.col("sec") + 90).alias("later_clock"), tc.display(F.col("code")).alias("shown"))


@query(
    "time_range_parse",
    f"""WITH {EVENTS_SQL}, q AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'what about DAY ' || d || ' ' || lpad((sec // 3600)::VARCHAR, 2, '0') || ':' || lpad((sec // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((sec % 60)::VARCHAR, 2, '0')
      || ' - day ' || (d + 1) || ' 00:10:00?' ELSE 'DAY 3 11:00:00 only' END AS text FROM ev),
    x AS (SELECT event_id, regexp_extract_all(text, '(?i)DAY\\s*(\\d+)\\s+(\\d{{1,2}}):(\\d{{2}}):(\\d{{2}})', 1) AS d, regexp_extract_all(text, '(?i)DAY\\s*(\\d+)\\s+(\\d{{1,2}}):(\\d{{2}}):(\\d{{2}})', 2) AS h,
      regexp_extract_all(text, '(?i)DAY\\s*(\\d+)\\s+(\\d{{1,2}}):(\\d{{2}}):(\\d{{2}})', 3) AS m, regexp_extract_all(text, '(?i)DAY\\s*(\\d+)\\s+(\\d{{1,2}}):(\\d{{2}}):(\\d{{2}})', 4) AS s FROM q)
    SELECT event_id, len(d) >= 2 AS is_range,
      CASE WHEN len(d) >= 2 THEN d[1]::BIGINT * 100000000 + h[1]::BIGINT * 1000000 + m[1]::BIGINT * 10000 + s[1]::BIGINT * 100 END AS range_start,
      CASE WHEN len(d) >= 2 THEN d[2]::BIGINT * 100000000 + h[2]::BIGINT * 1000000 + m[2]::BIGINT * 10000 + s[2]::BIGINT * 100 END AS range_end FROM x""",
)
def time_range_parse(spark, sf_dir):
    e = clock_events(spark, sf_dir)
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("what about DAY "), F.col("d").cast("string"), F.lit(" "), tc.human_clock(F.col("sec")), F.lit(" - day "), (F.col("d") + 1).cast("string"), F.lit(" 00:10:00?"))).otherwise("DAY 3 11:00:00 only")
    b = tc.range_bounds(F.col("text"))
    return e.withColumn("text", text).select("event_id", tc.is_range_query(F.col("text")).alias("is_range"), b["start"].alias("range_start"), b["end"].alias("range_end"))


@query("asof_filter_index", f"WITH {_CAPTIONS} SELECT event_type, count(*) AS n, max(code) AS indexed_time FROM cap WHERE code <= 1512000000 AND value IS NOT NULL GROUP BY event_type")
def asof_filter_index(spark, sf_dir, until=15_12000000):
    c = _captions(spark, sf_dir).filter((F.col("code") <= until) & F.col("value").isNotNull())
    return c.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("code").alias("indexed_time"))


@query(
    "asof_snapshot",
    """WITH snap AS (SELECT DISTINCT o_orderpriority AS k, o_orderdate AS ts FROM orders WHERE o_orderstatus = 'F'),
    q AS (SELECT o_orderkey, o_orderpriority AS k, o_orderdate AS at FROM orders)
    SELECT q.o_orderkey, s.ts AS snapshot FROM q ASOF LEFT JOIN snap s ON q.k = s.k AND q.at >= s.ts""",
)
def asof_snapshot(spark, sf_dir):
    """Every order with the latest snapshot of its priority; snapshots are the dates of finished orders."""
    o = table(spark, sf_dir, "orders")
    q = o.select("o_orderkey", F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("at"))
    s = o.filter(F.col("o_orderstatus") == "F").select(F.col("o_orderpriority").alias("k"), F.col("o_orderdate").alias("ts"))
    return intervals.asof_backward(q, s, "at", "ts", ["k"]).select("o_orderkey", "snapshot")


@query("interval_overlap_inclusive", f"WITH {_CAPTIONS}, q AS (SELECT event_id AS query_id, start_s AS q_start, start_s + 60 AS q_end FROM cap WHERE event_type = 'purchase') SELECT query_id, count(*) AS clips, min(event_id) AS first_clip, max(event_id) AS last_clip FROM q JOIN cap ON start_s <= q_end AND end_s >= q_start GROUP BY query_id")
def interval_overlap_inclusive(spark, sf_dir):
    c = _captions(spark, sf_dir)
    q = c.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("query_id"), F.col("start_s").alias("q_start"), (F.col("start_s") + 60).alias("q_end"))
    hits = intervals.overlap_join(c.select("event_id", "start_s", "end_s"), q, ("start_s", "end_s"), ("q_start", "q_end"), 60, inclusive=True)
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("clips"), F.min("event_id").alias("first_clip"), F.max("event_id").alias("last_clip"))


@query(
    "segment_overlap_halfopen",
    f"""WITH {_CAPTIONS}, days AS (SELECT d, max(sec) + 30 AS duration FROM cap GROUP BY d),
    seg AS (SELECT d, duration, unnest(range(greatest(ceil(duration / 600.0), 1)::BIGINT)) AS seg FROM days),
    s AS (SELECT d, seg, seg * 600 AS seg_start, least((seg + 1) * 600, duration) AS seg_end FROM seg)
    SELECT s.d, s.seg, s.seg_start, s.seg_end, count(event_id) AS cues, coalesce(sum(event_id), 0)::BIGINT AS ids FROM s LEFT JOIN cap c ON c.d = s.d AND c.sec + 30 > s.seg_start AND c.sec < s.seg_end GROUP BY ALL""",
)
def segment_overlap_halfopen(spark, sf_dir):
    c = _captions(spark, sf_dir).select("event_id", "d", F.col("sec").alias("c_start"), (F.col("sec") + 30).alias("c_end"))
    days = c.groupBy("d").agg(F.max("c_end").alias("duration"))
    seg = intervals.fixed_segments(days, "duration", 600).select("d", "seg", "seg_start", "seg_end")
    hits = intervals.overlap_join(c, seg, ("c_start", "c_end"), ("seg_start", "seg_end"), 600, inclusive=False, on=["d"]).groupBy("d", "seg").agg(F.count(F.lit(1)).alias("cues"), F.sum("event_id").alias("ids"))
    return seg.join(hits, ["d", "seg"], "left").select("d", "seg", "seg_start", "seg_end", F.coalesce("cues", F.lit(0)).alias("cues"), F.coalesce("ids", F.lit(0)).alias("ids"))


@query(
    "point_in_segment",
    f"""WITH {_CAPTIONS}, iv AS (SELECT event_id AS ordinal, d, sec AS i_start, sec + 30 AS i_end FROM cap WHERE event_type = 'purchase'),
    p AS (SELECT event_id, d, sec FROM cap),
    h AS (SELECT p.event_id, min(ordinal) AS ordinal FROM p JOIN iv ON p.d = iv.d AND p.sec BETWEEN i_start AND i_end GROUP BY 1)
    SELECT p.event_id, coalesce(iv.i_start, 0) AS i_start, coalesce(iv.i_end, 0) AS i_end FROM p LEFT JOIN h USING (event_id) LEFT JOIN iv ON h.ordinal = iv.ordinal""",
)
def point_in_segment(spark, sf_dir):
    c = _captions(spark, sf_dir)
    iv = c.filter(F.col("event_type") == "purchase").select(F.col("event_id").alias("ordinal"), "d", F.col("sec").alias("i_start"), (F.col("sec") + 30).alias("i_end"))
    p = c.select("event_id", "d", "sec")
    hit = intervals.containing_interval(p, iv, "sec", ("i_start", "i_end"), 30, "ordinal", ["event_id"], ["d"])
    return hit.select("event_id", F.coalesce("i_start", F.lit(0)).alias("i_start"), F.coalesce("i_end", F.lit(0)).alias("i_end"))


@query(
    "slot_containment",
    f"""WITH {EVENTS_SQL}, x AS (SELECT event_id, d, sec // 3600 AS h, sec % 3600 AS a, sec % 3600 + event_id % 20 AS b FROM ev), s AS (SELECT unnest(range(0, 3600, 30)) AS slot_start)
    SELECT d, h, slot_start, count(*) AS inside, min(event_id) AS first_event FROM x JOIN s ON a >= slot_start AND b <= slot_start + 30 GROUP BY ALL""",
)
def slot_containment(spark, sf_dir):
    """Spans that lie inside one 30-second slot of their hour, ends included."""
    x = clock_events(spark, sf_dir).select("event_id", "d", F.floor(F.col("sec") / 3600).alias("h"), (F.col("sec") % 3600).alias("a"), (F.col("sec") % 3600 + F.col("event_id") % 20).alias("b"))
    # A span can lie in the slot of its start, or, if empty and on a border, also in the slot before.
    near = x.withColumn("slot_start", F.explode(F.array(F.floor(F.col("a") / 30) * 30, F.floor(F.col("a") / 30) * 30 - 30)))
    inside = near.filter((F.col("slot_start") >= 0) & (F.col("a") >= F.col("slot_start")) & (F.col("b") <= F.col("slot_start") + 30))
    return inside.groupBy("d", "h", "slot_start").agg(F.count(F.lit(1)).alias("inside"), F.min("event_id").alias("first_event"))


def _window_sql(source: str, start: str, width: int, by: str) -> str:
    return f"""SELECT *, CASE WHEN {start} < s0 + {width} THEN s0 ELSE {start} // {width} * {width} END AS w_start FROM (SELECT *, min({start}) OVER (PARTITION BY {by}) AS s0 FROM {source})"""


@query(
    "anchored_tumbling_rollup",
    f"""WITH {_CAPTIONS}, w AS ({_window_sql('cap', 'sec', 600, 'd')})
    SELECT d, w_start, w_start + 600 AS w_end, count(*) AS n, max(sec) AS last_end, string_agg(event_type, chr(10) ORDER BY sec, event_id) AS text FROM w GROUP BY d, w_start""",
)
def anchored_tumbling_rollup(spark, sf_dir):
    c = _captions(spark, sf_dir)
    return windows.rollup_windows(c.withColumn("stop", F.col("sec")), "sec", "stop", "event_type", 600, ["d"], "event_id")


@query(
    "multiscale_three_levels",
    f"""WITH {_CAPTIONS}, a AS ({_window_sql('cap', 'sec', 180, 'd')}), a1 AS (SELECT d, w_start AS sec, count(*) AS n FROM a GROUP BY 1, 2),
    b AS ({_window_sql('a1', 'sec', 600, 'd')}), b1 AS (SELECT d, w_start AS sec, sum(n) AS n FROM b GROUP BY 1, 2),
    c AS ({_window_sql('b1', 'sec', 3600, 'd')}), c1 AS (SELECT d, w_start AS sec, sum(n) AS n FROM c GROUP BY 1, 2)
    SELECT '3min' AS granularity, d, sec AS w_start, n::BIGINT AS n FROM a1 UNION ALL SELECT '10min', d, sec, n::BIGINT FROM b1 UNION ALL SELECT '1h', d, sec, n::BIGINT FROM c1""",
)
def multiscale_three_levels(spark, sf_dir):
    """Each level reads the one before, as captions of captions."""
    level, out = _captions(spark, sf_dir).select("d", "sec", F.lit(1).cast("long").alias("n")), None
    for name, width in (("3min", 180), ("10min", 600), ("1h", 3600)):
        level = windows.anchored_windows(level, "sec", width, ["d"]).groupBy("d", F.col("w_start").alias("sec")).agg(F.sum("n").alias("n"))
        one = level.select(F.lit(name).alias("granularity"), "d", F.col("sec").alias("w_start"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("group_every_n", f"WITH {_CAPTIONS}, g AS (SELECT *, (row_number() OVER (PARTITION BY d ORDER BY event_id) - 1) // 10 AS group_no FROM cap) SELECT d, group_no, count(*) AS n, max_by(code, event_id) AS key, string_agg(event_type, ',' ORDER BY event_id) AS items FROM g GROUP BY d, group_no")
def group_every_n(spark, sf_dir):
    g = windows.every_n(_captions(spark, sf_dir), "event_id", 10, ["d"])
    items = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda e: e["event_type"]), ",")
    return g.groupBy("d", "group_no").agg(F.count(F.lit(1)).alias("n"), F.max_by("code", "event_id").alias("key"), items.alias("items"))


_LIN = "list_transform(range({m}), lambda i: floor(i * (n - 1) / {m1})::BIGINT)"


@query("linspace_sample", f"WITH {_CAPTIONS}, x AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM cap) SELECT user_id, event_id FROM x WHERE n <= 8 OR list_contains({_LIN.format(m=8, m1='7.0')}, pos)")
def linspace_sample(spark, sf_dir):
    return windows.linspace_sample(_captions(spark, sf_dir), ["sec", "event_id"], 8, ["user_id"]).select("user_id", "event_id")


@query(
    "proportional_sample",
    f"""WITH {_CAPTIONS}, x AS (SELECT event_id, d, event_type, row_number() OVER (PARTITION BY d, event_type ORDER BY sec, event_id) - 1 AS pos, count(*) OVER (PARTITION BY d, event_type) AS n FROM cap),
    y AS (SELECT *, greatest(1, floor(n * 0.1))::BIGINT AS m FROM x)
    SELECT d, event_type, event_id FROM y WHERE list_contains(list_transform(range(m), lambda i: CASE WHEN m = 1 THEN 0 ELSE floor(i * (n - 1) / (m - 1.0)) END::BIGINT), pos)""",
)
def proportional_sample(spark, sf_dir):
    return windows.proportional_sample(_captions(spark, sf_dir), ["sec", "event_id"], 0.1, ["d", "event_type"]).select("d", "event_type", "event_id")


@query("contiguous_splits", "WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, (pos // ceil(n / 7.0)::BIGINT)::INT AS split FROM x")
def contiguous_splits(spark, sf_dir):
    return windows.contiguous_splits(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("caption_normalise", f"WITH {_CAPTIONS} SELECT '30sec_' || (row_number() OVER (PARTITION BY d ORDER BY event_id) - 1)::VARCHAR AS id, d, event_id, code AS start_ts FROM cap")
def caption_normalise(spark, sf_dir):
    c = _captions(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("d").orderBy("event_id")) - 1
    return c.select(F.concat(F.lit("30sec_"), n.cast("string")).alias("id"), "d", "event_id", F.col("code").alias("start_ts"))


@query("frame_budget", f"WITH {_CAPTIONS}, x AS (SELECT d, count(*) AS clips FROM cap GROUP BY d) SELECT d, clips, greatest(1, 64 // clips) AS per_clip, len(list_distinct(list_transform(range(64), lambda i: floor(i * (clips - 1) / 63.0)::BIGINT)))::BIGINT AS kept FROM x")
def frame_budget(spark, sf_dir):
    """An even budget of 64 frames over a day's clips, and how many distinct clips linspace picks."""
    x = _captions(spark, sf_dir).groupBy("d").agg(F.count(F.lit(1)).alias("clips"))
    return x.select("d", "clips", F.greatest(F.lit(1).cast("long"), F.floor(F.lit(64) / F.col("clips"))).alias("per_clip"), F.size(F.array_distinct(windows.linspace_positions(F.col("clips"), 64))).cast("long").alias("kept"))
