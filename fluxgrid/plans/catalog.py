"""Registry of the queries over the harness tables and of their SQL.

Each query adapts harness tables to an operator's inputs; the SQL states the
same result in another way (no pigeonhole slices, no buckets, no validity
intervals), so that it is an independent oracle.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgrid.functions import scalars as S
from fluxgrid.operators import builds as B
from fluxgrid.operators import dataset as D
from fluxgrid.operators import fusion as U
from fluxgrid.operators import gating as G
from fluxgrid.operators import reports as R
from fluxgrid.operators import scans as C
from fluxgrid.operators import sequences as Q
from fluxgrid.session import configure, shared_dir
from fluxgrid.streaming.evaluate_stream import STATE_SETTINGS, stream_evaluate

QUERIES: dict = {}
ORACLE_SQL: dict = {}
HOUR_NS = 3_600_000_000_000
#: State stores for the ten rigs: modulo 23 their hashes all differ (modulo 24 seven do).
RIG_STORES = 23
CONFIG = U.FusionConfig(warning_distance_m=25.0, critical_distance_m=10.0, sensor_stale_after_ms=3_600_000.0, vision_stale_after_ms=7_200_000.0, vision_confidence=0.35)


@dataclass(frozen=True)
class Tables:
    """The harness tables by name."""

    spark: SparkSession
    folder: str

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The table as a stream; as a pattern, its path may name a file as well as a folder."""
        return self.spark.readStream.schema(self(name).schema).parquet(f"{self.folder}/{name}.parque[t]")


def query(sql: str | None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(configure(spark), sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def ns(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def split_of(key: Column) -> Column:
    return F.when(F.pmod(key, F.lit(10)) < 7, "train").when(F.pmod(key, F.lit(10)) < 9, "val").otherwise("test")


SPLIT = "CASE WHEN {0} % 10 < 7 THEN 'train' WHEN {0} % 10 < 9 THEN 'val' ELSE 'test' END"
KIND = "CASE event_type WHEN 'signup' THEN 'imu' WHEN 'click' THEN 'ultrasonic' ELSE 'tof' END"
READING_SQL = f"""
readings AS (SELECT user_id % 10 AS rig_id, event_id AS seq, user_id AS sensor_id, {KIND} AS kind, epoch_us(ts) * 1000 AS timestamp_ns,
  CASE user_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS sector, value AS distance_m, event_type <> 'error' AS valid FROM events),
latest AS (SELECT a.rig_id, a.seq, a.timestamp_ns AS now, b.sensor_id, arg_max(struct_pack(ts := b.timestamp_ns, kind := b.kind, d := b.distance_m, s := b.sector, v := b.valid), b.seq) AS r
  FROM readings a JOIN readings b ON a.rig_id = b.rig_id AND b.seq <= a.seq AND b.timestamp_ns >= a.timestamp_ns - 3 * {HOUR_NS} GROUP BY ALL),
live AS (SELECT rig_id, seq, r.d AS d, r.s AS s FROM latest WHERE now - r.ts BETWEEN 0 AND {HOUR_NS} AND r.v AND r.kind IN ('tof', 'ultrasonic') AND r.d > 0 AND isfinite(r.d)),
near AS (SELECT rig_id, seq, min(d) AS nearest, count(*) AS n, list_sort(list_distinct(list(s) FILTER (d <= 10))) AS c, list_sort(list_distinct(list(s) FILTER (d <= 25))) AS w FROM live GROUP BY ALL),
decisions AS (SELECT r.rig_id, r.seq, r.timestamp_ns, CASE WHEN nearest IS NULL THEN 'sensor_fault' WHEN nearest <= 10 THEN 'critical' WHEN nearest <= 25 THEN 'warning' ELSE 'clear' END AS level,
  nearest AS nearest_distance_m, coalesce(n, 0) AS n, c, w FROM readings r LEFT JOIN near USING (rig_id, seq))"""


def readings(t) -> DataFrame:
    e = t("events")
    kind = F.when(F.col("event_type") == "signup", "imu").when(F.col("event_type") == "click", "ultrasonic").otherwise("tof")
    sector = F.element_at(F.array(F.lit("left"), F.lit("center"), F.lit("right")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select((F.col("user_id") % 10).alias("rig_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("sensor_id"), kind.alias("kind"), ns(F.col("ts")).alias("timestamp_ns"), sector.alias("sector"), F.col("value").alias("distance_m"), (F.col("event_type") != "error").alias("valid"))


def joined(c: str) -> Column:
    return F.array_join(c, ",")


@query(f"""WITH {READING_SQL} SELECT rig_id, seq, timestamp_ns, level, array_to_string(CASE level WHEN 'critical' THEN c WHEN 'warning' THEN w WHEN 'sensor_fault' THEN ['unknown'] ELSE [] END, ',') AS sectors,
  nearest_distance_m, CAST(n AS INTEGER) AS fresh_range_sensor_count, level IN ('warning', 'critical') AS range_triggered FROM decisions""")
def fusion_replay(t):
    """Hazard decisions of every event as a range reading."""
    return U.fuse_ranges(readings(t), CONFIG).withColumn("sectors", joined("sectors"))


@query(f"""WITH {READING_SQL} SELECT rig_id, seq, level, CASE level WHEN 'critical' THEN 1.0 WHEN 'warning' THEN 0.65 WHEN 'sensor_fault' THEN 0.35 ELSE 0.0 END::DOUBLE AS intensity,
  CAST(CASE level WHEN 'critical' THEN 100 WHEN 'warning' THEN 250 WHEN 'sensor_fault' THEN 1000 END AS INTEGER) AS pulse_period_ms FROM decisions""")
def fusion_haptic(t):
    """The command of every decision."""
    return U.replay(readings(t), CONFIG).select("rig_id", "seq", "level", "intensity", "pulse_period_ms")


@query(f"""WITH {READING_SQL}, frames AS (SELECT user_id % 10 AS rig_id, event_id AS seq, epoch_us(ts) * 1000 AS fin, value / 100 AS conf, event_type AS label,
  CASE user_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS s FROM events WHERE event_type IN ('view', 'purchase'))
SELECT d.rig_id, d.seq, d.level, CASE WHEN d.level <> 'sensor_fault' AND d.timestamp_ns - f.fin BETWEEN 0 AND 2 * {HOUR_NS} AND f.conf >= 0.35
    AND (d.level = 'clear' OR list_contains(CASE d.level WHEN 'critical' THEN c ELSE w END, f.s)) THEN f.label ELSE '' END AS semantic_labels
FROM decisions d ASOF LEFT JOIN frames f ON d.rig_id = f.rig_id AND d.seq >= f.seq""")
def fusion_vision_labels(t):
    """Decisions with the labels of the latest frame: views and purchases are frames of one detection."""
    frames = vision_frames(t("events"))
    return U.attach_vision(U.fuse_ranges(readings(t), CONFIG), frames, CONFIG).select("rig_id", "seq", "level", joined("semantic_labels").alias("semantic_labels"))


EVALUATED_SQL = f"""WITH {READING_SQL}, frames AS (SELECT user_id % 10 AS rig_id, event_id AS seq, epoch_us(ts) * 1000 AS fin, value / 100 AS conf, event_type AS label,
  CASE user_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'center' ELSE 'right' END AS s FROM events WHERE event_type IN ('view', 'purchase')),
seen AS (SELECT d.*, CASE WHEN d.level <> 'sensor_fault' AND d.timestamp_ns - f.fin BETWEEN 0 AND 2 * {HOUR_NS} AND f.conf >= 0.35
    AND (d.level = 'clear' OR list_contains(CASE d.level WHEN 'critical' THEN c ELSE w END, f.s)) THEN f.label ELSE '' END AS semantic_labels
  FROM decisions d ASOF LEFT JOIN frames f ON d.rig_id = f.rig_id AND d.seq >= f.seq)
SELECT rig_id, seq, level, nearest_distance_m, CAST(n AS INTEGER) AS fresh_range_sensor_count, semantic_labels,
  CASE level WHEN 'critical' THEN 1.0 WHEN 'warning' THEN 0.65 WHEN 'sensor_fault' THEN 0.35 ELSE 0.0 END::DOUBLE AS intensity,
  CASE level WHEN 'sensor_fault' THEN 'no fresh valid range sensor reading' WHEN 'clear' THEN 'all fresh range readings exceed warning distance'
    ELSE printf('nearest range %.3f m', nearest_distance_m) || CASE WHEN semantic_labels = '' THEN '' ELSE '; vision labels: ' || semantic_labels END END AS reason FROM seen"""


def vision_frames(events: DataFrame, *more: str) -> DataFrame:
    e = events.where(F.col("event_type").isin("view", "purchase"))
    sector = F.element_at(F.array(F.lit("left"), F.lit("center"), F.lit("right")), (F.col("user_id") % 3 + 1).cast("int"))
    detection = F.struct(F.col("event_type").alias("class_name"), (F.col("value") / 100).alias("confidence"), sector.alias("sector"))
    return e.select((F.col("user_id") % 10).alias("rig_id"), F.col("event_id").alias("seq"), ns(F.col("ts")).alias("model_finished_ns"), F.array(detection).alias("detections"), *more)


def evaluated(decisions: DataFrame) -> DataFrame:
    return decisions.select("rig_id", "seq", "level", "nearest_distance_m", "fresh_range_sensor_count", joined("semantic_labels").alias("semantic_labels"), "intensity", "reason")


@query(EVALUATED_SQL)
def fusion_evaluate(t):
    """Whole decisions, with labels, reason and command."""
    return evaluated(U.evaluate(readings(t), vision_frames(t("events")), CONFIG))


@query(EVALUATED_SQL)
def fusion_stream(t):
    """The same decisions from two streams over the events, run until all that is there is decided."""
    for key, value in STATE_SETTINGS.items():
        t.spark.conf.set(key, value)
    arrived = F.timestamp_millis(F.col("event_id") + 1)  # a time of zero is late from the start
    own = lambda name: t.stream(name).withColumn("arrived", arrived)
    r = readings(own).withColumn("arrived", F.timestamp_millis(F.col("seq") + 1))
    decided = evaluated(stream_evaluate(r, vision_frames(own("events"), "arrived"), CONFIG, "0 seconds"))
    place = f"{shared_dir(t.spark)}/fusion-{uuid.uuid4().hex}"
    stores, held = "spark.sql.shuffle.partitions", t.spark.conf.get("spark.sql.shuffle.partitions")
    # a stream keeps the number that it is started with; each store takes memory and 4 MB of disk, and ten rigs fill ten at most
    t.spark.conf.set(stores, str(min(int(held), RIG_STORES)))
    try:
        run = decided.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    finally:
        t.spark.conf.set(stores, held)
    run.awaitTermination()
    return t.spark.read.schema(decided.schema).parquet(f"{place}/out")


@query("SELECT user_id AS sensor_id, event_id AS seq, epoch_us(ts) * 1000 AS timestamp_ns, value AS distance_m FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_reading(t):
    """The newest reading per sensor."""
    return U.latest_reading(readings(t).select("sensor_id", "seq", "timestamp_ns", "distance_m"), ["sensor_id"]).select("sensor_id", "seq", "timestamp_ns", "distance_m")


@query("""WITH r AS (SELECT user_id % 10 AS rig_id, (event_id * 7919) % 10007 AS seq, event_id, epoch_us(ts) * 1000 AS timestamp_ns FROM events)
SELECT * FROM (SELECT rig_id, seq, event_id, timestamp_ns, lag(timestamp_ns) OVER (PARTITION BY rig_id ORDER BY seq, event_id) AS previous_ns FROM r) WHERE timestamp_ns < previous_ns""")
def monotonic_violations(t):
    """Readings older than their predecessor, in a shuffled arrival order."""
    r = t("events").select((F.col("user_id") % 10).alias("rig_id"), ((F.col("event_id") * 7919) % 10007).alias("n"), "event_id", ns(F.col("ts")).alias("timestamp_ns"))
    out = U.order_violations(r.withColumn("seq", F.struct("n", "event_id")), ["rig_id"])
    return out.select("rig_id", F.col("n").alias("seq"), "event_id", "timestamp_ns", "previous_ns")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 < 1.0 / 3 - 1e-12 THEN 'left' WHEN l_quantity / 50 > 2.0 / 3 + 1e-12 THEN 'right' ELSE 'center' END AS sector FROM lineitem")
def sector_assign(t):
    """Sector of each line's quantity in a width of 50."""
    return t("lineitem").select("l_orderkey", "l_linenumber", S.horizontal_sector(F.col("l_quantity"), F.lit(50)).alias("sector"))


SUMMARY_SQL = "count({0}) AS count, avg({0}) AS mean, coalesce(stddev_samp({0}), 0) AS stdev, min({0}) AS min, quantile_cont({0}, 0.5) AS p50, quantile_cont({0}, 0.95) AS p95, quantile_cont({0}, 0.99) AS p99, max({0}) AS max, CASE WHEN avg({0}) > 0 THEN 1000 / avg({0}) ELSE 0 END AS rate"
ROUNDED = ("mean", "stdev", "min", "p50", "p95", "p99", "max", "rate")


def rounded_sql(inner: str, keys: str, digits: int = 6) -> str:
    return f"SELECT {keys}, count, " + ", ".join(f"round({c}, {digits}) AS {c}" for c in ROUNDED) + f" FROM ({inner})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in ROUNDED else F.col(c) for c in df.columns])


@query(rounded_sql(" UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, '{m}' AS metric, {SUMMARY_SQL.format(m)} FROM lineitem GROUP BY ALL" for m in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")), "l_returnflag, l_linestatus, metric"))
def stage_summary(t):
    """Exact summaries of four metrics by flag and status."""
    return rounded(Q.summarize_metrics(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@query(rounded_sql(f"WITH x AS (SELECT o_orderpriority, unnest(['price', 'cents']) AS stage, unnest([o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 100 END]) AS v FROM orders) SELECT o_orderpriority, stage, {SUMMARY_SQL.format('v')} FROM x WHERE v IS NOT NULL GROUP BY ALL", "o_orderpriority, stage", 4))
def sparse_stage_summary(t):
    """Summaries over sparse stage maps: the second stage is there for a third of the rows."""
    m = F.map_filter(F.create_map(F.lit("price"), F.col("o_totalprice"), F.lit("cents"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 100)), lambda _, v: v.isNotNull())
    return rounded(Q.summarize_stages(t("orders").select("o_orderpriority", m.alias("stage_ms")), ["o_orderpriority"]), 4)


@query(rounded_sql(f"""WITH w AS (SELECT user_id, epoch_us(date_trunc('day', min(ts))) * 1000 AS a, epoch_us(date_trunc('day', min(ts))) * 1000 + 86400000000000 * 7 AS b FROM events GROUP BY 1)
SELECT user_id, {SUMMARY_SQL.format('value')} FROM w JOIN events e USING (user_id) WHERE epoch_us(ts) * 1000 BETWEEN a AND b GROUP BY 1""", "user_id"))
def power_window(t):
    """Summary of each user's values within the week from their first day."""
    e = t("events").select("user_id", ns(F.col("ts")).alias("timestamp_ns"), F.col("value"))
    day = 86_400_000_000_000
    start = F.floor(F.min("timestamp_ns") / day) * day
    w = e.groupBy("user_id").agg(F.lit(0).alias("window_id"), start.alias("started_ns")).withColumn("finished_ns", F.col("started_ns") + 7 * day)
    return rounded(Q.interval_summary(e, w, ["user_id"], "value").drop("window_id", "started_ns", "finished_ns"))


@query("""WITH c AS (SELECT c_nationkey AS id, avg(c_acctbal) AS bal, max(c_acctbal) AS top FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1), s AS (SELECT s_nationkey AS k, avg(s_acctbal) / 10000 AS q FROM supplier GROUP BY 1)
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 <> 0 THEN upper(n_name) ELSE n_name END AS model, round(CASE WHEN n_nationkey % 5 <> 1 THEN bal END, 4) AS mean_ms, round(CASE WHEN n_nationkey % 5 <> 1 THEN top END, 4) AS max_ms,
  round(q * 100, 4) AS map50_percent, CASE WHEN bal IS NULL THEN 'pending' WHEN n_nationkey % 5 = 1 THEN 'failed' ELSE 'complete' END AS status FROM nation LEFT JOIN c ON c.id = n_nationkey LEFT JOIN s ON s.k = n_nationkey""")
def report_tables(t):
    """Experiments (nations) with their reports (customers) and registry (suppliers); some are pending or failed."""
    matrix = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("model"), F.col("n_nationkey").alias("model_key"))
    status = F.when(F.col("c_nationkey") % 5 == 1, "failed").otherwise("complete")
    reports = t("customer").where("c_nationkey % 3 <> 0").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean_ms"), F.max("c_acctbal").alias("max_ms")).withColumn("status", status)
    names = t("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.upper("n_name").alias("model"))
    reports = reports.join(names, "c_nationkey").withColumnRenamed("c_nationkey", "id")
    registry = t("supplier").groupBy(F.col("s_nationkey").alias("model_key")).agg((F.avg("s_acctbal") / 10000).alias("map50")).withColumns({"map50_95": F.lit(None).cast("double"), "recall": F.lit(None).cast("double")})
    out = R.report_table(matrix, reports, registry, ["model"], ["mean_ms", "max_ms"])
    return out.select("id", "model", *[F.round(c, 4).alias(c) for c in ("mean_ms", "max_ms", "map50_percent")], "status")


CLASSES_SQL = "classes AS (SELECT DISTINCT p_type AS source_class, CASE WHEN p_type LIKE '%TIN' THEN NULL ELSE split_part(p_type, ' ', 1) END AS target_class FROM part)"


@query(f"WITH {CLASSES_SQL} SELECT coalesce(target_class, '(dropped)') AS target_class, count(*) AS annotations, count(DISTINCT p_brand) AS sources FROM part JOIN classes ON p_type = source_class GROUP BY 1")
def class_harmonize(t):
    """Parts by target class: types map to their first word, one metal to nothing."""
    p = t("part")
    target = F.when(F.col("source_class").endswith("TIN"), None).otherwise(F.substring_index("source_class", " ", 1))
    classes = p.select(F.col("p_type").alias("source_class")).distinct().withColumn("target_class", target)
    return p.join(classes, p["p_type"] == classes["source_class"]).groupBy(F.coalesce("target_class", F.lit("(dropped)")).alias("target_class")).agg(F.count("*").alias("annotations"), F.countDistinct("p_brand").alias("sources"))


LINE = "concat_ws(' ', CASE WHEN l_orderkey % 11 = 0 THEN '1.5' ELSE CAST(l_linenumber - 1 AS VARCHAR) END, CAST(l_discount * 5 AS VARCHAR), CAST(l_tax * 10 AS VARCHAR), CAST(l_quantity / 60 AS VARCHAR), CAST(l_quantity / 100 AS VARCHAR))"


def label_lines(t) -> DataFrame:
    l = t("lineitem")
    return l.select(
        F.lit("s").alias("source"), "l_orderkey", F.col("l_linenumber").alias("line_no"),
        F.concat_ws(" ", F.when(F.col("l_orderkey") % 11 == 0, "1.5").otherwise((F.col("l_linenumber") - 1).cast("string")), *[x.cast("string") for x in (F.col("l_discount") * 5, F.col("l_tax") * 10, F.col("l_quantity") / 60, F.col("l_quantity") / 100)]).alias("text"),
    )


@query("""WITH b AS (SELECT l_orderkey, l_linenumber AS line_no, l_orderkey % 11 = 0 AS bad, l_linenumber - 1 AS k, l_discount * 5 AS x, l_tax * 10 AS y, l_quantity / 60 AS w, l_quantity / 100 AS h FROM lineitem)
SELECT l_orderkey, line_no, CASE WHEN bad THEN 'invalid class id' WHEN k >= 6 THEN 'class id outside source taxonomy' WHEN k = 5 THEN 'source class has no explicit mapping' WHEN k = 2 THEN NULL
  WHEN NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND w BETWEEN 0 AND 1 AND h BETWEEN 0 AND 1) THEN 'not normalized' WHEN w <= 0 OR h <= 0 THEN 'width and height must be positive'
  WHEN x - w / 2 < -1e-6 OR x + w / 2 > 1 + 1e-6 THEN 'outside image width' WHEN y - h / 2 < -1e-6 OR y + h / 2 > 1 + 1e-6 THEN 'outside image height' END AS error,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN k = 2 THEN 'dropped' ELSE 'kept' END AS status, round(CASE WHEN status = 'kept' THEN x END, 9) AS center_x FROM b""")
def label_parse(t):
    """Lines of text parsed as label lines: kept, dropped by mapping, or the first rule that they break."""
    names = [(k, f"c{k}", None if k == 2 else f"t{k}", k != 5) for k in range(6)]
    lines = label_lines(t)
    classes = lines.sparkSession.createDataFrame([("s", *n) for n in names], "source string, class_id int, source_class string, target_class string, mapped boolean")
    return D.parse_labels(lines, classes).select("l_orderkey", "line_no", "error", "status", F.round("center_x", 9).alias("center_x"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber AS n, l_orderkey % 11 = 0 AS bad, l_linenumber - 1 AS k, l_discount * 5 AS x, l_tax * 10 AS y, l_quantity / 60 AS w, l_quantity / 100 AS h FROM lineitem),
e AS (SELECT l_orderkey, n, CASE WHEN bad THEN 'line ' || n || ': non-numeric field' WHEN k >= 5 THEN 'line ' || n || ': class ' || k || ' outside [0,5)' WHEN NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) THEN 'line ' || n || ': center outside normalized bounds'
  WHEN NOT (w > 0 AND w <= 1 AND h > 0 AND h <= 1) THEN 'line ' || n || ': box size outside normalized bounds' END AS error FROM b)
SELECT l_orderkey, string_agg(error, '; ' ORDER BY n) AS errors FROM e WHERE error IS NOT NULL GROUP BY 1""")
def label_audit_errors(t):
    """Per order, the audit's errors of its lines in line order."""
    return D.errors_by_key(D.audit_lines(label_lines(t), 5), ["l_orderkey"]).select("l_orderkey", F.array_join("errors", "; ").alias("errors"))


@query(f"""SELECT sha256(text) AS sha256, array_to_string(list_sort(list_distinct(list({SPLIT.format('doc_id')}))), ',') AS splits, array_to_string(list_sort(list(lpad(CAST(doc_id AS VARCHAR), 12, '0'))), ',') AS paths,
  count(*) AS n, count(DISTINCT {SPLIT.format('doc_id')}) > 1 AS cross_split FROM documents GROUP BY 1 HAVING count(*) > 1""")
def exact_dup_groups(t):
    """Documents of equal content, and whether they cross splits."""
    r = t("documents").select(F.sha2("text", 256).alias("sha256"), split_of(F.col("doc_id")).alias("split"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"))
    return D.exact_groups(r).withColumns({"splits": joined("splits"), "paths": joined("paths")})


DEDUP_SQL = f"""images AS (SELECT d.doc_id, source, {SPLIT.format('d.doc_id')} AS split, lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS path, sha256(text) AS sha, l.doc_id IS NOT NULL AS has_label, 2 AS lines, CASE WHEN toxic = 1 THEN 0 ELSE 1 + quality END AS kept_lines FROM documents d LEFT JOIN labels l USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY CASE split WHEN 'test' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, source, path) AS rk FROM images),
judged AS (SELECT r.*, CASE WHEN NOT has_label THEN 'missing_label' WHEN EXISTS (SELECT 1 FROM ranked o WHERE o.sha = r.sha AND o.rk < r.rk AND o.has_label AND o.kept_lines > 0) THEN 'duplicate' WHEN kept_lines = 0 THEN 'all_dropped' ELSE 'kept' END AS status FROM ranked r)"""


def judged_images(t) -> DataFrame:
    d = t("documents").select("doc_id", "source", split_of(F.col("doc_id")).alias("split"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.sha2("text", 256).alias("sha256"))
    l = t("labels").withColumn("has_label", F.lit(True))
    j = d.join(l, "doc_id", "left").withColumn("has_label", F.coalesce("has_label", F.lit(False)))
    return D.deduplicate_by_priority(j.withColumns({"lines": F.lit(2), "kept_lines": F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))}))


@query(f"WITH {DEDUP_SQL} SELECT doc_id, split, status FROM judged")
def priority_dedup(t):
    """Status of each document as an image: labels from ``labels``; all of a toxic one's are dropped."""
    return judged_images(t).select("doc_id", "split", "status")


@query(f"""WITH {DEDUP_SQL} SELECT count(*) AS images_seen, count_if(status = 'missing_label')::BIGINT AS missing_label_files, count_if(status = 'duplicate')::BIGINT AS duplicate_images_skipped, count_if(status = 'all_dropped')::BIGINT AS images_skipped_after_all_labels_dropped,
  sum(CASE WHEN status IN ('kept', 'all_dropped') THEN 2 - kept_lines ELSE 0 END)::BIGINT AS annotations_dropped_by_mapping, sum(CASE WHEN status = 'kept' THEN kept_lines ELSE 0 END)::BIGINT AS annotations_retained,
  count_if(status = 'kept' AND split = 'train')::BIGINT AS images_train, count_if(status = 'kept' AND split = 'val')::BIGINT AS images_val, count_if(status = 'kept' AND split = 'test')::BIGINT AS images_test FROM judged""")
def build_statistics(t):
    """The counters of that build."""
    return D.build_statistics(judged_images(t))


@query(f"SELECT lower(regexp_replace(p_name, '\\.rf\\.[0-9a-f]{{16,64}}$', '', 'i')) AS lineage, array_to_string(list_sort(list_distinct(list({SPLIT.format('p_partkey')}))), ',') AS splits, count(*) AS images FROM part GROUP BY 1 HAVING count(DISTINCT {SPLIT.format('p_partkey')}) > 1")
def lineage_ambiguous(t):
    """Part names as lineage keys that occur in several splits."""
    return D.ambiguous_lineages(t("part").select(F.col("p_name").alias("stem"), split_of(F.col("p_partkey")).alias("split"))).withColumn("splits", joined("splits"))


def hash_records(t) -> DataFrame:
    """Embeddings as records: 63 sign bits of every fourth dimension's neighbourhood as a perceptual hash."""
    v = F.col("embedding")
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(62)), F.lit(0).cast("bigint"), lambda a, i: F.shiftleft(a, 1).bitwiseOR(F.when(F.get(v, i) > F.get(v, i + 1), F.lit(1)).otherwise(F.lit(0)).cast("bigint")))
    source = F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string"), F.lit("__"))
    return t("embeddings").select(split_of(F.col("vec_id")).alias("split"), F.concat(source, F.lpad(F.col("vec_id").cast("string"), 10, "0")).alias("path"), F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"), bits.alias("dhash64"))


NEAR_SQL = f"""rec AS MATERIALIZED (SELECT {SPLIT.format('vec_id')} AS split, 's' || (vec_id % 4) || '__' || lpad(CAST(vec_id AS VARCHAR), 10, '0') AS path, vec_id,
  CAST(list_sum(list_transform(range(63), lambda i: CASE WHEN embedding[i + 1] > embedding[i + 2] THEN CAST(1 AS BIGINT) << CAST(62 - i AS INTEGER) ELSE 0 END)) AS BIGINT) AS h FROM embeddings),
ordered AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS o FROM rec),
pairs AS MATERIALIZED (SELECT CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS hamming_distance, a.split AS left_split, a.path AS left_path, b.split AS right_split, b.path AS right_path FROM ordered a JOIN ordered b ON a.split <> b.split AND (a.o, a.path) < (b.o, b.path) AND bit_count(xor(a.h, b.h)) <= 18)"""


@query(f"WITH {NEAR_SQL} SELECT * FROM pairs")
def near_dup_pairs(t):
    """Records of different splits whose hashes differ in at most 18 bits."""
    return D.near_pairs(hash_records(t), 18)


REMOVE_SQL = """same AS (SELECT *, (CASE left_split WHEN 'test' THEN 3 WHEN 'val' THEN 2 ELSE 1 END) < (CASE right_split WHEN 'test' THEN 3 WHEN 'val' THEN 2 ELSE 1 END) AS lg FROM pairs WHERE split_part(left_path, '__', 1) = split_part(right_path, '__', 1)),
gone AS (SELECT CASE WHEN lg THEN left_path ELSE right_path END AS removed_path, string_agg(CASE WHEN lg THEN right_path ELSE left_path END, ',' ORDER BY hamming_distance, left_path, right_path) AS kept_paths, min(hamming_distance) AS min_distance FROM same GROUP BY 1)"""


@query(f"WITH {NEAR_SQL}, {REMOVE_SQL} SELECT * FROM gone")
def removals(t):
    """What decontamination removes, and for what."""
    return D.removals(D.near_pairs(hash_records(t), 18)).withColumn("kept_paths", joined("kept_paths"))


@query(f"WITH {NEAR_SQL}, {REMOVE_SQL} SELECT path, split FROM rec WHERE path NOT IN (SELECT removed_path FROM gone)")
def decontaminate(t):
    """The records that stay."""
    r = hash_records(t)
    return D.decontaminate(r, D.near_pairs(r, 18)).select("path", "split")


@query(f"""WITH img AS (SELECT doc_id, {SPLIT.format('doc_id')} AS split, sha256(text) AS sha, doc_id // 2 * 2654435761 AS h, doc_id % 50 = 0 AS broken FROM documents),
ok AS (SELECT *, CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END AS o FROM img WHERE NOT broken), groups AS (SELECT sha, count(*) AS n, count(DISTINCT split) AS s FROM ok GROUP BY 1),
found AS (SELECT (SELECT count(*) FROM img WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS missing_labels, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id IN (SELECT doc_id FROM img) AND toxic = 0) AS invalid_label_files,
  (SELECT count(*) FROM img WHERE broken) AS unreadable_images, (SELECT count(DISTINCT doc_id) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM img)) AS orphan_labels, (SELECT count(*) FROM groups WHERE n > 1 AND s > 1) AS cross_split_groups,
  (SELECT count(*) FROM groups WHERE n > 1) AS exact_groups, (SELECT count(*) FROM ok a JOIN ok b ON (a.o, a.doc_id) < (b.o, b.doc_id) AND a.o <> b.o AND a.sha <> b.sha AND bit_count(xor(a.h, b.h)) <= 3) AS pairs)
SELECT *, missing_labels + invalid_label_files + unreadable_images + orphan_labels + cross_split_groups AS hard_error_count, hard_error_count = 0 AS gate_passed, pairs > 0 AS visual_review_required FROM found""")
def audit_summary(t):
    """The audit of documents as images: every fiftieth cannot be read, labels are label lines whose height is toxicity."""
    path = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    images = t("documents").select(split_of(F.col("doc_id")).alias("split"), path.alias("path"), path.alias("stem"), F.sha2("text", 256).alias("sha256"), (F.floor(F.col("doc_id") / 2) * 2654435761).alias("dhash64"), F.when(F.col("doc_id") % 50 == 0, "broken").alias("fault"))
    text = F.concat(F.col("quality").cast("string"), F.lit(" 0.5 0.5 0.2 "), F.col("toxic").cast("string"))
    labels = t("labels").select(split_of(F.col("doc_id")).alias("split"), path.alias("stem"), F.lit(1).alias("line_no"), text.alias("text"))
    return B.audit_summary(B.audit_tables(images, labels, 2, 3))


@query("SELECT doc_id, 'orphan' AS problem FROM labels WHERE doc_id % 7 = 0 UNION ALL SELECT doc_id, 'unlabelled' FROM documents WHERE doc_id % 7 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_labels(t):
    """Labels without a document (those of every seventh are left out), and documents without labels."""
    d, l = t("documents").where("doc_id % 7 <> 0").select("doc_id"), t("labels").select("doc_id")
    bare = D.pair_labels(d, l, ["doc_id"]).where("not has_label")
    return D.orphan_labels(l, d, ["doc_id"]).select("doc_id", F.lit("orphan").alias("problem")).unionByName(bare.select("doc_id", F.lit("unlabelled").alias("problem")))


def history(t) -> DataFrame:
    return t("lineitem").select(F.col("l_partkey").alias("run"), F.col("l_linenumber").alias("epoch"), F.col("l_orderkey").alias("source_idx"), F.col("l_suppkey").alias("row_idx"), F.col("l_orderkey").alias("source"), F.col("l_discount").alias("metric"), F.col("l_quantity").alias("time"))


@query("""WITH s AS (SELECT l_partkey AS run, l_linenumber AS epoch, l_orderkey AS source, l_discount AS metric, lag(l_discount) OVER w AS p, lead(l_orderkey) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_partkey, l_linenumber ORDER BY l_orderkey, l_suppkey))
SELECT run, epoch, count_if(n IS NULL)::BIGINT AS accepted, max(CASE WHEN n IS NULL THEN source END) AS accepted_source, count_if(n IS NOT NULL)::BIGINT AS duplicates,
  count_if(p IS NOT NULL AND abs(p - metric) > greatest(1e-9 * greatest(abs(p), abs(metric)), 1e-12))::BIGINT AS divergent FROM s GROUP BY ALL""")
def history_merge(t):
    """Merged histories (parts are runs, orders checkpoints, line numbers epochs): accepted, duplicate and divergent rows."""
    a, d, v = Q.merge_history(history(t), ["run"], ["metric"])
    n = lambda df, name: df.groupBy("run", "epoch").agg(F.count("*").alias(name))
    out = a.groupBy("run", "epoch").agg(F.count("*").alias("accepted"), F.max("source").alias("accepted_source")).join(n(d, "duplicates"), ["run", "epoch"], "left").join(n(v, "divergent"), ["run", "epoch"], "left")
    return out.na.fill(0, ["duplicates", "divergent"])


@query("WITH g AS (SELECT l_partkey, max(l_linenumber) AS m FROM lineitem GROUP BY 1), e AS (SELECT l_partkey, unnest(range(1, m + 1)) AS k FROM g) SELECT l_partkey, CAST(k AS INTEGER) AS missing_l_linenumber FROM e WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = e.l_partkey AND l.l_linenumber = k)")
def epoch_gaps(t):
    """Line numbers that a part lacks below its greatest."""
    return Q.missing_epochs(t("lineitem"), ["l_partkey"], "l_linenumber")


@query("""WITH s AS (SELECT user_id, event_id, event_type <> 'error' AS ok, sum(CAST(event_type <> 'error' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events),
k AS (SELECT user_id, event_id, CAST(sum(CAST(NOT ok AS INTEGER)) OVER (PARTITION BY user_id, island ORDER BY event_id) AS INTEGER) AS streak FROM s) SELECT user_id, event_id, streak, max(streak) OVER (PARTITION BY user_id ORDER BY event_id) >= 2 AS stopped FROM k""")
def failure_streaks(t):
    """Running failure streaks of each user, stopped at two."""
    e = t("events").select("user_id", "event_id", "event_type")
    return Q.failure_streaks(e, ["user_id"], "event_id", F.col("event_type") != "error", 2).drop("event_type")


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
w(user_id, k, n, e) AS (SELECT user_id, k, n, CAST(value AS DOUBLE) FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.n, w.e * CAST(0.85 AS DOUBLE) + o.value * CAST(0.15 AS DOUBLE) FROM w JOIN o ON o.user_id = w.user_id AND o.k = w.k + 1)
SELECT user_id, round(e, 6) AS ewma, CAST(n AS INTEGER) AS n FROM w WHERE k = n""")
def ewma(t):
    """Smoothed value of each user."""
    e = t("events").select("user_id", F.struct("ts", "event_id").alias("at"), "value")
    return C.ewma(e, ["user_id"], "at", "value").withColumn("ewma", F.round("ewma", 6))


@query("""WITH RECURSIVE o AS (SELECT user_id % 3 AS k, event_id, value, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS i FROM events),
w(k, i, event_id, e) AS (SELECT k, i, event_id, CAST(value AS DOUBLE) FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, o.event_id, w.e * CAST(0.85 AS DOUBLE) + o.value * CAST(0.15 AS DOUBLE) FROM w JOIN o ON o.k = w.k AND o.i = w.i + 1)
SELECT k, event_id, round(e + 1e-9::DOUBLE, 6) AS ewma FROM w""")
def ewma_running(t):
    """The smoothed value after every event, of three large groups of users; moved off the ties of rounding."""
    e = t("events").select((F.col("user_id") % 3).alias("k"), "event_id", "value")
    return C.running_ewma(e, ["k"], ["event_id"], "value").withColumn("ewma", F.round(F.col("ewma") + 1e-9, 6))


@query(rounded_sql(f"SELECT l_linenumber, {SUMMARY_SQL.format('l_extendedprice')} FROM lineitem GROUP BY ALL", "l_linenumber"))
def large_summary(t):
    """Exact summaries by line number; those of more than five thousand lines by refinement, without holding their values."""
    return rounded(Q.summarize(t("lineitem"), ["l_linenumber"], "l_extendedprice", 5_000))


@query("SELECT user_id, date_trunc('hour', ts) AS hour, max(event_id) AS event_id, arg_max(value, event_id) AS value, count(*) - 1 AS dropped FROM events GROUP BY ALL")
def conflated_latest(t):
    """Per user and hour the newest event, and how many it displaced."""
    e = t("events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_id", "value")
    return Q.conflate(e, ["user_id", "hour"], "event_id")


@query("SELECT user_id, event_id, greatest(0, event_id - coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY value, event_id), 0)) AS event_id_delta FROM events")
def counter_deltas(t):
    """Growth of a counter read in another order, never negative."""
    e = t("events").select("user_id", F.struct("value", "event_id").alias("at"), "event_id")
    return Q.counter_deltas(e, ["user_id"], "at", "event_id").drop("at")


@query(rounded_sql(f"SELECT user_id, {SUMMARY_SQL.format('value')} FROM (SELECT user_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 20) GROUP BY 1", "user_id"))
def warmup_excluded(t):
    """Summary of each user's values after the first twenty."""
    return rounded(Q.summarize(Q.after_warmup(t("events").select("user_id", "event_id", "value"), ["user_id"], "event_id", 20), ["user_id"]))


@query("""WITH o AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, o_orderkey FROM o WHERE list_contains(list_transform(range(30), lambda i: least(CAST(floor(i * (n / 30.0::DOUBLE)) AS BIGINT), n - 1)), k)""")
def even_sample(t):
    """Thirty evenly spaced orders of each priority."""
    return Q.even_sample(t("orders").select("o_orderpriority", "o_orderkey"), ["o_orderpriority"], "o_orderkey", 30)


@query("""WITH RECURSIVE rec AS MATERIALIZED (SELECT doc_id, list_filter([lang, CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS c FROM documents LEFT JOIN labels USING (doc_id)),
every AS (SELECT list_sort(list_distinct(flatten(list(c)))) AS v FROM rec),
greedy(i, chosen) AS (SELECT 0, CAST([] AS BIGINT[]) UNION ALL
  SELECT i + 1, list_filter(list_append(chosen, (SELECT arg_max(doc_id, (len(c), -doc_id)) FROM rec WHERE list_contains(c, v[i + 1]) AND NOT list_contains(chosen, doc_id))), lambda x: x IS NOT NULL) FROM greedy, every WHERE i < len(v)),
first AS (SELECT arg_max(chosen, i) AS chosen FROM greedy),
blank AS (SELECT list(doc_id ORDER BY doc_id) AS b FROM rec WHERE len(c) = 0),
taken AS (SELECT list_concat(chosen, coalesce(b[1:least(3, greatest(0, 30 - len(chosen)))], [])) AS t FROM first, blank),
rest AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM rec WHERE NOT list_contains((SELECT t FROM taken), doc_id)),
spaced AS (SELECT r.doc_id FROM rest r, taken WHERE k IN (SELECT least(CAST(floor(i * (r.n / CAST(30 - len(t) AS DOUBLE))) AS BIGINT), r.n - 1) FROM range(30 - len(t)) AS x(i))),
picked AS (SELECT list_concat(t, (SELECT coalesce(list(doc_id ORDER BY doc_id), []) FROM spaced))[1:30] AS p FROM taken)
SELECT doc_id, array_to_string(c, ',') AS classes, CAST(list_position(p, doc_id) - 1 AS INTEGER) AS position FROM rec, picked WHERE list_contains(p, doc_id)""")
def fixture_cover(t):
    """Thirty documents that cover all languages and labels: a greedy choice among the best of each class, then empty and evenly spaced ones."""
    l = t("labels").select("doc_id", F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"))).alias("c"))
    d = t("documents").join(l, "doc_id", "left").select("doc_id", F.concat(F.array("lang"), F.coalesce("c", F.array().cast("array<string>"))).alias("classes"))
    return R.cover_sample(d, "doc_id", "classes", 30).withColumn("classes", joined("classes"))


CHECK_SQL = "j AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 9 = 0 THEN 'no resumable epoch' WHEN o_orderstatus = 'P' THEN 'no optimizer state' WHEN o_orderpriority = '5-LOW' THEN 'taxonomy mismatch' END AS reject_reason FROM orders)"


def checkpoints(t) -> DataFrame:
    o = t("orders")
    return R.judged_checkpoints(
        o.select("o_custkey", "o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 9 == 0, 0).otherwise(1).alias("completed_epoch"), (F.col("o_orderstatus") != "P").alias("optimizer_present"), F.array((F.col("o_orderpriority") != "5-LOW").cast("string")).alias("names")),
        F.array(F.lit("true")),
    )


@query(f"WITH {CHECK_SQL} SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM j WHERE reject_reason IS NULL GROUP BY 1")
def best_checkpoint(t):
    """Per customer the greatest order that may be resumed from."""
    ok = checkpoints(t).where("reject_reason is null").select("o_custkey", "o_orderkey", "o_totalprice")
    return R.best_by(ok, ["o_custkey"], ["o_totalprice", "o_orderkey"])


@query(f"WITH {CHECK_SQL} SELECT reject_reason, count(*) AS n FROM j WHERE reject_reason IS NOT NULL GROUP BY 1")
def rejected_checkpoints(t):
    """Why orders were rejected."""
    return checkpoints(t).where("reject_reason is not null").groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT source, lang || CASE WHEN doc_id % 2 = 0 THEN '-x/' ELSE '/' END || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS path, sha256(text) AS sha FROM documents)
SELECT source, sha256(string_agg(path || chr(0) || sha || chr(10), '' ORDER BY string_split(path, '/'))) AS tree_sha256, count(*) AS files FROM f GROUP BY 1""")
def tree_hash(t):
    """One hash per source over its documents as files in folders, in order of path parts."""
    path = F.concat("lang", F.when(F.col("doc_id") % 2 == 0, "-x/").otherwise("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    return R.tree_hash(t("documents").select("source", path.alias("path"), F.sha2("text", 256).alias("sha256")), ["source"])


@query("""WITH a AS (SELECT list_distinct(list(split_part(p_type, ' ', 1))) AS l FROM part), b AS (SELECT ['ECONOMY', 'PROMO', 'UNKNOWN', 'LARGE'] AS r)
SELECT array_to_string(list_sort(list_filter(l, lambda x: NOT list_contains(r, x))), ',') AS missing, array_to_string(list_sort(list_filter(r, lambda x: NOT list_contains(l, x))), ',') AS extra FROM a, b""")
def taxonomy_diff(t):
    """Classes without a mapping and mappings without a class."""
    have = t("part").agg(F.collect_set(F.substring_index("p_type", " ", 1)).alias("l"))
    d = R.set_difference(F.col("l"), F.array(*[F.lit(x) for x in ("ECONOMY", "PROMO", "UNKNOWN", "LARGE")]))
    return have.select(joined(d["missing"]).alias("missing"), joined(d["extra"]).alias("extra"))


@query("""SELECT unnest(['unique_orders', 'no_null_price', 'all_final', 'starts_at_one']) AS gate, unnest([count(*) = count(DISTINCT o_orderkey), count_if(o_totalprice IS NULL) = 0, bool_and(o_orderstatus = 'F'), min(o_orderkey) = 1]) AS ok FROM orders""")
def gate_report(t):
    """Boolean gates over the orders, a row each."""
    row = t("orders").agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("u"), F.count_if(F.col("o_totalprice").isNull()).alias("z"), F.bool_and(F.col("o_orderstatus") == "F").alias("f"), F.min("o_orderkey").alias("m"))
    return R.gates(row, R.gate("unique_orders", F.col("n") == F.col("u")), R.gate("no_null_price", F.col("z") == 0), R.gate("all_final", F.col("f")), R.gate("starts_at_one", F.col("m") == 1))


@query("""WITH f AS (SELECT c_custkey, c_acctbal, count(o_orderkey) AS n, count_if(o_orderstatus = 'P') AS pending, max(o_totalprice) AS top, min(o_totalprice) AS low FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
own AS (SELECT c_custkey, CASE WHEN n = 0 THEN 'no orders' END AS i, CASE WHEN coalesce(pending > 2, true) THEN 'pending: ' || pending END AS h,
  CASE WHEN coalesce(top > 400000, true) THEN 'above limit' WHEN coalesce(low < 2000, true) THEN 'below limit' END AS c, CASE WHEN c_acctbal < 0 THEN 'in debt' END AS r FROM f),
g AS (SELECT c_custkey, 'import' AS gate, 0 AS level, i AS reason, NULL::VARCHAR AS blocked_by FROM own
  UNION ALL SELECT c_custkey, 'history', 1, CASE WHEN i IS NULL THEN h END, CASE WHEN i IS NOT NULL THEN 'import' END FROM own
  UNION ALL SELECT c_custkey, 'comparison', 1, CASE WHEN i IS NULL THEN c END, CASE WHEN i IS NOT NULL THEN 'import' END FROM own
  UNION ALL SELECT c_custkey, 'release', 2, CASE WHEN i IS NULL AND h IS NULL AND c IS NULL THEN r END, CASE WHEN i IS NOT NULL THEN 'import' WHEN c IS NOT NULL THEN 'comparison' WHEN h IS NOT NULL THEN 'history' END FROM own)
SELECT c_custkey, gate, level::INTEGER AS level, CASE WHEN blocked_by IS NOT NULL THEN 'blocked' WHEN reason IS NOT NULL THEN 'failed' ELSE 'complete' END AS status, reason, blocked_by FROM g""")
def gate_chain(t):
    """Four gates with prerequisites for every customer and their orders: complete, failed with the reason, or blocked by the first that failed."""
    o = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"))
    facts = t("customer").select("c_custkey", "c_acctbal").join(o, "c_custkey", "left").na.fill(0, ["n", "pending"])
    rules = [
        G.Rule("release", [(F.col("c_acctbal") < 0, "in debt")], ("history", "comparison")),
        G.Rule("comparison", [(F.col("top") > 400000, "above limit"), (F.col("low") < 2000, "below limit")], ("import",)),
        G.Rule("history", [(F.col("pending") > 2, F.concat(F.lit("pending: "), F.col("pending").cast("string")))], ("import",)),
        G.Rule("import", [(F.col("n") == 0, "no orders")]),
    ]
    return G.judged(facts, ["c_custkey"], rules)


@query("""WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, conv_id % 4 <> 0 AND NOT (conv_id % 7 = 3 AND turn % 4 = 1) AS ran, length(text) % 5 = 0 AS silent, length(text) % 11 = 0 AND length(text) % 5 <> 0 AS err FROM conversations WHERE role = 'assistant'),
g AS (SELECT conv_id, count(*) AS code_cells, coalesce(list(i ORDER BY i) FILTER (WHERE NOT ran), []) AS u, coalesce(list(i ORDER BY i) FILTER (WHERE err), []) AS e, coalesce(list(i ORDER BY i) FILTER (WHERE silent AND i >= 2), []) AS m FROM t GROUP BY 1),
j AS (SELECT c.conv_id, coalesce(code_cells, 0) AS code_cells, coalesce(u, []) AS u, coalesce(e, []) AS e, CASE WHEN len(u) = code_cells THEN m ELSE [] END AS m FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN g USING (conv_id))
SELECT conv_id, code_cells, array_to_string(u, ',') AS unexecuted, array_to_string(e, ',') AS errors, array_to_string(m, ',') AS missing_output, len(e) = 0 AND (len(u) = 0 OR len(u) = code_cells) AND len(m) = 0 AS valid FROM j""")
def notebook_check(t):
    """Conversations as notebooks, the assistant's turns as code cells: which are valid, and which cells are at fault."""
    n = F.length("text")
    output = F.struct(F.when(n % 11 == 0, "error").otherwise("stream").alias("output_type"), F.lit("ValueError").alias("ename"))
    outputs = F.when(n % 5 == 0, F.array().cast("array<struct<output_type: string, ename: string>>")).otherwise(F.array(output))
    ran = (F.col("conv_id") % 4 != 0) & ~((F.col("conv_id") % 7 == 3) & (F.col("turn") % 4 == 1))
    cell = F.struct(F.when(F.col("role") == "assistant", "code").otherwise("markdown").alias("cell_type"), F.when(ran, F.col("turn")).alias("execution_count"), outputs.alias("outputs"))
    books = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", cell.alias("cell")))).alias("c"))
    text = F.to_json(F.struct(F.transform("c", lambda x: x["cell"]).alias("cells")), {"ignoreNullFields": "false"})
    r = G.notebook_report(books.select(F.col("conv_id").alias("path"), text.alias("text")))
    named = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return r.select(F.col("path").alias("conv_id"), "code_cells", named("unexecuted"), F.array_join(F.transform("errors", lambda x: x["index"].cast("string")), ",").alias("errors"), named("missing_output"), "valid")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS map50, coalesce(CAST(json_extract(props, '$.fitness') AS DOUBLE), 0.0) AS fitness FROM events")
def json_metrics(t):
    """Metrics renamed out of free-form JSON, with a default."""
    pick = lambda k, kind: F.get_json_object("props", f"$.{k}").cast(kind)
    return t("events").select("event_id", pick("k", "bigint").alias("map50"), F.coalesce(pick("fitness", "double"), F.lit(0.0)).alias("fitness"))


@query("SELECT 'n' || n_nationkey AS id, n_name AS model, CAST(NULL AS INTEGER) AS threads FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, 4 FROM region")
def union_matrix(t):
    """Two sets of experiments with different settings as one."""
    n = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("model"))
    r = t("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("model"), F.lit(4).alias("threads"))
    return R.union_matrix(n, r)


@query("SELECT r_name, CAST(rep AS INTEGER) AS repetition FROM region, range(1, 4) AS x(rep)")
def repetitions(t):
    """Every region three times."""
    return Q.repetitions(t("region").select("r_name"), 3)


@query("SELECT x.i AS frame_id, n_name FROM range(100) AS x(i) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS k FROM nation) n ON n.k = x.i % 25")
def cyclic_frames(t):
    """A hundred reads of the nations in turn."""
    return Q.cyclic(t("nation").select("n_name", "n_nationkey"), 100, "n_nationkey").select("frame_id", "n_name")


@query("""SELECT n_nationkey, unnest(['region', 'name']) AS "check", unnest([coalesce(n_regionkey = r, false), coalesce(n_name = m, false)]) AS ok FROM nation LEFT JOIN (SELECT n_nationkey AS k, n_regionkey % 4 AS r, CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) ELSE n_name END AS m FROM nation WHERE n_nationkey % 5 <> 0) ON k = n_nationkey""")
def hash_consistency(t):
    """Equality checks between two inventories, a missing side failing."""
    n = t("nation").select("n_nationkey", "n_regionkey", "n_name")
    o = n.where("n_nationkey % 5 <> 0").select("n_nationkey", (F.col("n_regionkey") % 4).alias("r"), F.when(F.col("n_nationkey") % 6 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("m"))
    return R.consistency(n, o, "n_nationkey", {"region": ("n_regionkey", "r"), "name": ("n_name", "m")})


@query("SELECT n_name, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'complete' ELSE 'missing' END AS status FROM nation")
def required_status(t):
    """The status of everything required."""
    have = t("supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("status", F.lit("complete"))
    return R.status_of(t("nation").select("n_nationkey", "n_name"), have, "n_nationkey").select("n_name", "status")


@query("SELECT c_nationkey, coalesce(arg_min(c_custkey, c_custkey) FILTER (c_acctbal < 0), max(c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def preferred_input(t):
    """Per nation the first customer in debt, else the last customer."""
    return R.preferred(t("customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], F.col("c_acctbal") < 0, "c_custkey").select("c_nationkey", "c_custkey")


@query(f"SELECT split, coalesce(n, 0) AS count FROM (SELECT unnest(['train', 'val', 'test', 'extra']) AS split) LEFT JOIN (SELECT {SPLIT.format('doc_id')} AS split, count(*) AS n FROM documents GROUP BY 1) USING (split)")
def split_counts(t):
    """Documents per split, with zero for an empty one."""
    return D.counts_zero_filled(t("documents").select(split_of(F.col("doc_id")).alias("split")), "split", ["train", "val", "test", "extra"])


@query(None)
def overlap_suppression(t):
    """Best boxes of each order's lines per status, overlapping ones dropped (a sequential rule)."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 2000
    box = F.struct(x.alias("x1"), y.alias("y1"), (x + 20).alias("x2"), (y + 20).alias("y2"))
    d = t("lineitem").select("l_orderkey", "l_linestatus", F.col("l_linenumber").alias("box_id"), F.col("l_discount").alias("confidence"), box.alias("box"))
    return D.suppress_overlaps(d, ["l_orderkey", "l_linestatus"], 0.5).select("l_orderkey", "l_linestatus", "box_id", "confidence")
