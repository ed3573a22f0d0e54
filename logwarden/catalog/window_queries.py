"""Sliding counts, distincts, running history, as-of matches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timefn import DAY, HOUR, MINUTE, SECOND
from ..operators.asof import first_match
from ..operators.recent import sliding_values as recent_values
from ..operators.running import Running, previous_row, running
from ..operators.sequence import gap_cv, gaps, last_n, mean_gap_s
from ..operators.sweep import Count, Distinct, Streak, sweep
from ..plans.rules import account_history, prepare
from ..sources.attempts import read_attempts
from .feature_queries import USER_CTE
from .fixture import with_attempts
from .registry import query


def trailing(us: int) -> str:
    return f"RANGE BETWEEN {us - 1} PRECEDING AND CURRENT ROW"


FAIL = "SUM(CASE WHEN success THEN 0 ELSE 1 END)"


@query(
    "sliding_counts",
    with_attempts(
        f"""SELECT row_id, CAST({FAIL} OVER (PARTITION BY username ORDER BY t {trailing(300 * SECOND)}) AS BIGINT) AS fails_name_5m,
        CAST({FAIL} OVER (PARTITION BY ip ORDER BY t {trailing(300 * SECOND)}) AS BIGINT) AS fails_ip_5m,
        CAST({FAIL} OVER (PARTITION BY ip ORDER BY t {trailing(HOUR)}) AS BIGINT) AS fails_ip_1h,
        CASE WHEN asn IS NOT NULL THEN CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY asn ORDER BY t {trailing(300 * SECOND)}) AS BIGINT) END AS oks_asn_5m
        FROM attempts""", 720),
)
def sliding_counts(spark, sf):
    fail = ~F.col("success")
    df = read_attempts(spark, sf, 720).select("row_id", "t", "username", "ip", "asn", "success")
    df = sweep(df, "username", [Count("fails_name_5m", 300 * SECOND, fail)])
    df = sweep(df, "ip", [Count("fails_ip_5m", 300 * SECOND, fail), Count("fails_ip_1h", HOUR, fail)])
    df = sweep(df, "asn", [Count("oks_asn_5m", 300 * SECOND, F.col("success"))])
    return df.select("row_id", "fails_name_5m", "fails_ip_5m", "fails_ip_1h", "oks_asn_5m")


@query(
    "sliding_distinct",
    with_attempts(
        f"""SELECT row_id,
        COUNT(DISTINCT CASE WHEN NOT success THEN username END) OVER (PARTITION BY ip ORDER BY t {trailing(300 * SECOND)}) AS users_ip_5m,
        COUNT(DISTINCT CASE WHEN NOT success THEN ip END) OVER (PARTITION BY username ORDER BY t {trailing(HOUR)}) AS ips_name_1h
        FROM attempts""", 720),
)
def sliding_distinct(spark, sf):
    fail = ~F.col("success")
    df = read_attempts(spark, sf, 720).select("row_id", "t", "username", "ip", "success")
    df = sweep(df, "ip", [Distinct("users_ip_5m", 300 * SECOND, F.col("username"), fail)])
    df = sweep(df, "username", [Distinct("ips_name_1h", HOUR, F.col("ip"), fail)])
    return df.select("row_id", "users_ip_5m", "ips_name_1h")


@query(
    "sliding_values",
    with_attempts(
        f"""SELECT row_id, COALESCE(array_to_string(list_sort(list_distinct(list(country) FILTER (WHERE success) OVER w)), ','), '') AS countries
        FROM attempts WHERE uid IS NOT NULL WINDOW w AS (PARTITION BY uid ORDER BY t {trailing(600 * SECOND)})""", 720),
)
def sliding_values(spark, sf):
    df = read_attempts(spark, sf, 720).where("uid IS NOT NULL")
    out = recent_values(df, "uid", F.col("country"), 600 * SECOND, when=F.col("success"))
    return out.select("row_id", F.array_join(F.sort_array("values"), ",").alias("countries"))


@query(
    "last_n_times",
    with_attempts(
        f"""SELECT row_id, array_to_string(list_filter(list(t) OVER (PARTITION BY ip ORDER BY t, row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), lambda x: x > t - {DAY}), ',') AS times
        FROM attempts WHERE NOT success""", 720),
)
def last_n_times(spark, sf):
    df = read_attempts(spark, sf, 720).where("NOT success").select("row_id", "t", "ip")
    out = last_n(df, "ip", 10, name="times", retention_us=DAY)
    return out.select("row_id", F.array_join(F.col("times").cast("array<string>"), ",").alias("times"))


@query(
    "gap_stats",
    with_attempts(
        """SELECT row_id, round(mean_gap, 6) AS mean_gap_s,
        round(CASE WHEN mean_gap <= 0 THEN 0.0 ELSE sqrt(list_sum(list_transform(g, lambda x: (x / 1000000.0::DOUBLE - mean_gap) * (x / 1000000.0::DOUBLE - mean_gap))) / len(g)) / mean_gap END, 6) AS cv
        FROM (SELECT row_id, g, list_sum(g) / len(g) / 1000000.0::DOUBLE AS mean_gap FROM
          (SELECT row_id, list_transform(range(1, len(ts)), lambda i: ts[i + 1] - ts[i]) AS g FROM
            (SELECT row_id, list(t) OVER (PARTITION BY ip ORDER BY t, row_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ts FROM attempts WHERE NOT success)
           WHERE len(ts) = 10))""", 720),
)
def gap_stats(spark, sf):
    df = read_attempts(spark, sf, 720).where("NOT success").select("row_id", "t", "ip")
    out = last_n(df, "ip", 10, name="times").where(F.size("times") == 10)
    return out.select("row_id", F.round(mean_gap_s(F.col("times")), 6).alias("mean_gap_s"), F.round(gap_cv(F.col("times")), 6).alias("cv"))


@query(
    "fail_streak",
    with_attempts("SELECT a.row_id, CAST(u.n_att - COALESCE(u.at_ok, 0) AS BIGINT) AS streak FROM attempts a LEFT JOIN usr u USING (row_id)", 1, USER_CTE),
)
def fail_streak(spark, sf):
    df = read_attempts(spark, sf).select("row_id", "t", "uid", "success")
    return sweep(df, "uid", [Streak("streak", F.col("success"))], boundary="open").select("row_id", "streak")


@query(
    "prev_event",
    with_attempts(
        """SELECT row_id, LAG(row_id) OVER w AS prev_row_id, LAG(t) OVER w AS prev_t, LAG(country) OVER w AS prev_country
        FROM attempts WHERE uid IS NOT NULL WINDOW w AS (PARTITION BY uid ORDER BY t, row_id)"""),
)
def prev_event(spark, sf):
    df = read_attempts(spark, sf).where("uid IS NOT NULL").select("row_id", "t", "uid", "country")
    out = previous_row(df, ["uid"], ["t", "row_id"], ["country"])
    return out.select("row_id", F.col("prev.row_id").alias("prev_row_id"), F.col("prev.t").alias("prev_t"), F.col("prev.country").alias("prev_country"))


@query(
    "account_history",
    with_attempts(
        """SELECT row_id, MAX(t) OVER w AS last_event_t, MAX(CASE WHEN success THEN t END) OVER w AS last_success_t,
        CASE WHEN COUNT(*) OVER w > 0 THEN CAST(COALESCE(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) END AS n_success,
        CAST(COALESCE(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY uid, country ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS country_seen,
        CAST(COALESCE(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY uid, ua ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS device_seen
        FROM attempts WHERE uid IS NOT NULL
        WINDOW w AS (PARTITION BY uid ORDER BY t, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""),
)
def account_history_query(spark, sf):
    df = prepare(read_attempts(spark, sf).where("uid IS NOT NULL"))
    out = account_history(df, slice_rows=4_000_000, total_rows=df.count())
    return out.select("row_id", F.col("prev.t").alias("last_event_t"), "last_success_t", F.col("n_success_before").alias("n_success"), "country_seen", "device_seen")


@query(
    "global_prefix",
    with_attempts(
        """SELECT row_id, CAST(SUM(CASE WHEN success AND uid IS NOT NULL AND asn IS NOT NULL THEN 1 ELSE 0 END) OVER (ORDER BY t, row_id) AS BIGINT) AS successes_so_far,
        ROW_NUMBER() OVER (ORDER BY t, row_id) AS position FROM attempts"""),
)
def global_prefix(spark, sf):
    df = read_attempts(spark, sf).select("row_id", "t", (F.col("success") & F.col("uid").isNotNull() & F.col("asn").isNotNull()).cast("int").alias("hit"))
    aggs = [Running("successes_so_far", "sum", F.col("hit"), "through_row"), Running("position", "sum", F.lit(1), "through_row")]
    # small slices on purpose: the running total is computed in parallel pieces
    return running(df, [], ["t", "row_id"], aggs, slice_rows=50_000).select("row_id", "successes_so_far", "position")


@query(
    "user_time_split",
    with_attempts(
        """SELECT row_id, CASE WHEN rn <= GREATEST(1, CAST(floor(0.7::DOUBLE * n) AS BIGINT)) THEN 'train' ELSE 'test' END AS part FROM
        (SELECT row_id, ROW_NUMBER() OVER (PARTITION BY uid ORDER BY t, row_id) AS rn, COUNT(*) OVER (PARTITION BY uid) AS n
         FROM attempts WHERE uid IS NOT NULL AND success)"""),
)
def user_time_split(spark, sf):
    df = read_attempts(spark, sf).where("uid IS NOT NULL AND success").select("row_id", "t", "uid")
    ranked = running(df, ["uid"], ["t", "row_id"], [Running("rn", "sum", F.lit(1), "through_row")])
    from ..operators.joins import lookup

    totals = df.groupBy(F.col("uid").alias("_u")).agg(F.count(F.lit(1)).alias("n"))
    both = lookup(ranked, totals, [("uid", "_u")])
    cut = F.greatest(F.lit(1), F.floor(F.lit(0.7) * F.col("n")))
    return both.select("row_id", F.when(F.col("rn") <= cut, "train").otherwise("test").alias("part"))


@query(
    "has_prior_success",
    with_attempts(
        """SELECT DISTINCT v.row_id FROM attempts v JOIN attempts e ON e.uid = v.uid AND e.t < v.t AND e.success
        WHERE v.success AND v.uid IS NOT NULL"""),
)
def has_prior_success(spark, sf):
    df = read_attempts(spark, sf).where("uid IS NOT NULL AND success").select("row_id", "t", "uid")
    first = df.groupBy(F.col("uid").alias("_u")).agg(F.min("t").alias("_first"))
    from ..operators.joins import lookup

    return lookup(df, first, [("uid", "_u")], how="inner").where("_first < t").select("row_id")


@query(
    "asof_first_match",
    with_attempts(
        f"""SELECT a.row_id AS anchor_id, COALESCE(h.donor_id, d.donor_id) AS donor_id,
        CASE WHEN h.donor_id IS NOT NULL THEN 1 WHEN d.donor_id IS NOT NULL THEN 2 END AS tier
        FROM anchors a
        LEFT JOIN LATERAL (SELECT min(x.row_id) AS donor_id FROM donors x WHERE x.country = a.country AND x.uid <> a.uid AND x.t = (SELECT MIN(y.t) FROM donors y
           WHERE y.country = a.country AND y.uid <> a.uid AND y.t > a.t AND y.t <= a.t + {HOUR})) h ON TRUE
        LEFT JOIN LATERAL (SELECT min(x.row_id) AS donor_id FROM donors x WHERE x.country = a.country AND x.uid <> a.uid AND x.t = (SELECT MIN(y.t) FROM donors y
           WHERE y.country = a.country AND y.uid <> a.uid AND y.t > a.t AND y.t <= a.t + {DAY})) d ON TRUE""",
        1,
        "donors AS (SELECT * FROM attempts WHERE success AND uid IS NOT NULL AND country IS NOT NULL)",
        "anchors AS (SELECT * FROM donors WHERE NOT is_attack_ip AND NOT is_ato)",
    ),
)
def asof_first_match(spark, sf):
    """The next success of another user from the same country, within an hour, else within a day."""
    df = read_attempts(spark, sf).where("success AND uid IS NOT NULL AND country IS NOT NULL")
    anchors = df.where("NOT is_attack_ip AND NOT is_ato").select("row_id", "t", "uid", "country")
    found = first_match(anchors, df.select("row_id", "t", "uid", "country"), same=["country"], horizons=[HOUR, DAY])
    return found.select("anchor_id", "donor_id", "tier")
