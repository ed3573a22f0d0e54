"""Ingest, projections, splits, aggregates, sampling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import splits as sp
from ..functions import text, timefn
from ..functions.geo import haversine_km
from ..operators.quantile import exact_quantiles
from ..plans import quality as ql
from ..plans.features import FEATURES, compute_features
from ..plans.simulate import KINDS, counterfactual_features, donors_for, select_anchors
from ..sources import csvlog
from ..sources.attempts import read_attempts, with_geo
from .feature_queries import ALL_CTES, FEATURES_CTE
from .fixture import geo_cte, with_attempts
from .registry import query

DAY = timefn.DAY
T0 = 1_704_067_200_000_000
CUT = sp.Cutoffs(T0 + 12 * DAY, T0 + 18 * DAY, T0 + 27 * DAY)
SPLIT = f"CASE WHEN t < {CUT.train_end} THEN 'train' WHEN t < {CUT.val_end} THEN 'val' WHEN t < {CUT.test_end} THEN 'test' ELSE 'late' END"
GROUP = "CASE WHEN ('0x' || substr(md5(ip), 1, 8))::BIGINT % 100 < 70 THEN 'train' WHEN ('0x' || substr(md5(ip), 1, 8))::BIGINT % 100 < 85 THEN 'val' ELSE 'test' END"
PART = f"""parts AS (SELECT *, CASE WHEN is_ato THEN 'ato' WHEN is_attack_ip AND ip_group <> CASE WHEN split_time = 'late' THEN 'test' ELSE split_time END THEN 'excluded' ELSE split_time END AS part
  FROM (SELECT *, {SPLIT} AS split_time, {GROUP} AS ip_group FROM attempts)),
weighted AS (SELECT *, CASE WHEN is_attack_ip AND part IN ('train', 'val', 'test', 'late') THEN CASE ip_group WHEN 'train' THEN 1 / 0.7::DOUBLE WHEN 'val' THEN 1 / 0.15::DOUBLE ELSE 1 / 0.15::DOUBLE END ELSE 1.0::DOUBLE END AS weight FROM parts)"""


@query(
    "ingest_typed",
    with_attempts("SELECT row_id, uid AS user_id, ip, asn, country, success, starts_with(ip, '10.') AS is_private_ip, COALESCE(asn >= 500000, FALSE) AS is_fake_asn, device_type IS NULL AS ua_parse_failed FROM attempts"),
)
def ingest_typed(spark, sf):
    """The log turned back into raw text columns and typed again."""
    a = read_attempts(spark, sf)
    raw = a.select(
        F.col("row_id").cast("string").alias("index"), F.timestamp_micros("t").cast("string").alias("Login Timestamp"), F.col("uid").cast("string").alias("User ID"),
        F.col("ip").alias("IP Address"), F.coalesce("country", F.lit("")).alias("Country"), F.coalesce(F.col("asn").cast("string"), F.lit("")).alias("ASN"),
        F.coalesce("device_type", F.lit("")).alias("Device Type"), F.initcap(F.col("success").cast("string")).alias("Login Successful"),
        F.initcap(F.col("is_attack_ip").cast("string")).alias("Is Attack IP"), F.initcap(F.col("is_ato").cast("string")).alias("Is Account Takeover"))
    out = csvlog.typed(raw)
    return out.select("row_id", "user_id", "ip", "asn", "country", "success", "is_private_ip", "is_fake_asn", "ua_parse_failed")


@query("scan_range", with_attempts(f"SELECT row_id, t, username, success FROM attempts WHERE t >= {T0 + 5 * DAY} AND t < {T0 + 9 * DAY}"))
def scan_range(spark, sf):
    return csvlog.scan_range(read_attempts(spark, sf), T0 + 5 * DAY, T0 + 9 * DAY).select("row_id", "t", "username", "success")


@query("labels_join", with_attempts("SELECT a.row_id, l.kind IS NOT NULL AS is_anomaly, l.kind AS anomaly_type FROM attempts a LEFT JOIN (SELECT row_id, 'takeover' AS kind FROM attempts WHERE is_ato) l USING (row_id) WHERE a.success"))
def labels_join(spark, sf):
    a = read_attempts(spark, sf)
    labels = a.where("is_ato").select("row_id", F.lit("takeover").alias("anomaly_type"))
    return a.where("success").select("row_id").join(labels, "row_id", "left").select("row_id", F.col("anomaly_type").isNotNull().alias("is_anomaly"), "anomaly_type")


@query(
    "log_integrity",
    with_attempts(
        """SELECT COUNT(*) AS n_rows, MIN(row_id) AS first_id, MAX(row_id) AS last_id, CAST(COALESCE(SUM(CASE WHEN row_id - p > 1 THEN row_id - p - 1 END), 0) AS BIGINT) AS missing_ids,
        COUNT(*) FILTER (WHERE row_id - p > 1) AS gaps, COUNT(*) FILTER (WHERE pt > t) AS backward_steps, COALESCE(MAX(CASE WHEN pt > t THEN pt - t END), 0) AS max_backward_us,
        MAX(row_id) - MIN(row_id) + 1 = COUNT(*) AS contiguous FROM (SELECT *, LAG(row_id) OVER (ORDER BY row_id) AS p, LAG(t) OVER (ORDER BY row_id) AS pt FROM attempts)"""),
)
def log_integrity(spark, sf):
    """Row ids and time order of the whole log, failed attempts as well."""
    return ql.log_integrity(read_attempts(spark, sf).select("row_id", "t"))


@query(
    "log_integrity_all",
    with_attempts(
        """SELECT COUNT(*) AS n_rows, MIN(row_id) AS first_id, MAX(row_id) AS last_id, CAST(COALESCE(SUM(CASE WHEN row_id - p > 1 THEN row_id - p - 1 END), 0) AS BIGINT) AS missing_ids,
        COUNT(*) FILTER (WHERE row_id - p > 1) AS gaps, COUNT(*) FILTER (WHERE pt > t) AS backward_steps, COALESCE(MAX(CASE WHEN pt > t THEN pt - t END), 0) AS max_backward_us,
        MAX(row_id) - MIN(row_id) + 1 = COUNT(*) AS contiguous FROM (SELECT *, LAG(row_id) OVER (ORDER BY row_id) AS p, LAG(t) OVER (ORDER BY row_id) AS pt FROM attempts)"""),
)
def log_integrity_all(spark, sf):
    """Integrity of the whole log, failed attempts as well."""
    return ql.log_integrity(read_attempts(spark, sf).select("row_id", "t"))


@query("strip_version", with_attempts("SELECT regexp_replace(COALESCE(browser, '∅'), ' +[0-9][0-9.]*$', '') AS browser_family, regexp_replace(COALESCE(os, '∅'), ' +[0-9][0-9.]*$', '') AS os_family, COUNT(*) AS n FROM attempts GROUP BY 1, 2"))
def strip_version(spark, sf):
    fam = lambda c: text.strip_version(text.or_missing(F.col(c)))
    return read_attempts(spark, sf).groupBy(fam("browser").alias("browser_family"), fam("os").alias("os_family")).agg(F.count(F.lit(1)).alias("n"))


@query("ua_fingerprint", with_attempts("SELECT row_id, CASE WHEN ua IS NULL THEN '' ELSE substr(sha1(ua), 1, 12) END AS ua_hash, substr(sha256(ua), 1, 32) AS fingerprint FROM attempts"))
def ua_fingerprint(spark, sf):
    return read_attempts(spark, sf).select("row_id", text.ua_hash(F.col("ua")).alias("ua_hash"), text.device_fingerprint(F.col("ua")).alias("fingerprint"))


@query("unknown_accounts", with_attempts("SELECT row_id, uid, CASE WHEN uid IS NULL THEN concat('?', CAST(row_id AS VARCHAR)) ELSE username END AS per_attempt, CASE WHEN uid IS NULL THEN concat('?', ip) ELSE username END AS per_ip FROM attempts"))
def unknown_accounts(spark, sf):
    missing = F.col("uid").isNull()
    return read_attempts(spark, sf).select(
        "row_id", "uid",
        F.when(missing, F.concat(F.lit("?"), F.col("row_id").cast("string"))).otherwise(F.col("username")).alias("per_attempt"),
        F.when(missing, F.concat(F.lit("?"), F.col("ip"))).otherwise(F.col("username")).alias("per_ip"))


@query(
    "hour_features",
    with_attempts(
        """SELECT row_id, round(h, 9) AS hour, CAST((dayofweek(make_timestamp(t)) + 6) % 7 AS INT) AS weekday, round(sin(2 * pi() * h / 24), 9) + 0.0::DOUBLE AS hour_sin, round(cos(2 * pi() * h / 24), 9) + 0.0::DOUBLE AS hour_cos,
        round(least(abs(h - 23.5::DOUBLE), 24 - abs(h - 23.5::DOUBLE)), 9) AS from_late_evening FROM (SELECT row_id, t, hour(make_timestamp(t)) + minute(make_timestamp(t)) / 60.0::DOUBLE AS h FROM attempts)"""),
)
def hour_features(spark, sf):
    h = timefn.hour_of_day(F.col("t"))
    return read_attempts(spark, sf).select(
        "row_id", F.round(h, 9).alias("hour"), timefn.weekday(F.col("t")).alias("weekday"), (F.round(timefn.hour_sin(h), 9) + F.lit(0.0)).alias("hour_sin"),
        (F.round(timefn.hour_cos(h), 9) + F.lit(0.0)).alias("hour_cos"), F.round(timefn.circular_hours(h, F.lit(23.5)), 9).alias("from_late_evening"))


@query("haversine", with_attempts("SELECT row_id, round(2 * 6371.0::DOUBLE * asin(least(1.0::DOUBLE, sqrt(pow(sin(radians(g.lat - 21.03) / 2), 2) + cos(radians(21.03::DOUBLE)) * cos(radians(g.lat)) * pow(sin(radians(g.lon - 105.85) / 2), 2)))), 6) AS km FROM attempts JOIN geo g USING (country)", 1, geo_cte()))
def haversine(spark, sf):
    df = with_geo(read_attempts(spark, sf)).where("lat IS NOT NULL")
    return df.select("row_id", F.round(haversine_km(F.lit(21.03), F.lit(105.85), F.col("lat"), F.col("lon")), 6).alias("km"))


@query("time_split", with_attempts(f"SELECT row_id, {SPLIT} AS split_time FROM attempts"))
def time_split(spark, sf):
    return read_attempts(spark, sf).select("row_id", sp.time_split(F.col("t"), CUT).alias("split_time"))


@query("ip_group", with_attempts(f"SELECT ip, {GROUP} AS ip_group, COUNT(*) AS n FROM attempts GROUP BY ip"))
def ip_group(spark, sf):
    return read_attempts(spark, sf).groupBy("ip").agg(F.count(F.lit(1)).alias("n")).select("ip", sp.ip_group(F.col("ip")).alias("ip_group"), "n")


@query("partition_assign", with_attempts("SELECT row_id, part, weight FROM weighted", 1, PART))
def partition_assign(spark, sf):
    return ql.with_partition(read_attempts(spark, sf), CUT).select("row_id", F.col("partition").alias("part"), "weight")


USTATS = "ustats AS (SELECT uid, COUNT(*) AS n_events, COUNT(*) FILTER (WHERE is_ato) AS n_ato FROM attempts WHERE uid IS NOT NULL GROUP BY 1)"


@query("user_stats", with_attempts("SELECT * FROM ustats", 1, USTATS))
def user_stats(spark, sf):
    return ql.user_stats(read_attempts(spark, sf))


def weighted(spark, sf):
    """Partitioned rows of known accounts with population weights."""
    df = ql.with_partition(read_attempts(spark, sf).where("uid IS NOT NULL"), CUT)
    st = ql.user_stats(df).select(F.col("uid").alias("_u"), sp.stratum(F.col("n_events")).alias("stratum"), (F.col("n_ato") > 0).alias("forced"))
    from ..operators.joins import lookup

    joined = lookup(df, st, [("uid", "_u")], how="inner").drop("_u")
    return joined.withColumn("pop_weight", sp.pop_weight(F.col("weight"), F.col("stratum"), F.col("forced")))


POP = "pop AS (SELECT w.*, w.weight / CASE WHEN s.n_ato > 0 THEN 1.0::DOUBLE WHEN s.n_events = 1 THEN 0.05::DOUBLE WHEN s.n_events <= 9 THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END AS pop_weight FROM weighted w JOIN ustats s USING (uid))"


@query("pop_weights", with_attempts("SELECT row_id, pop_weight FROM pop", 1, PART, USTATS, POP))
def pop_weights(spark, sf):
    return weighted(spark, sf).select("row_id", "pop_weight")


@query("history_buckets", with_attempts("SELECT CASE WHEN n_events < 1 THEN 'none' WHEN n_events < 5 THEN 'thin' ELSE 'thick' END AS bucket, CASE WHEN n_events = 1 THEN 'single' WHEN n_events <= 9 THEN 'light' ELSE 'heavy' END AS stratum, COUNT(*) AS users FROM ustats GROUP BY 1, 2", 1, USTATS))
def history_buckets(spark, sf):
    n = F.col("n_events")
    return ql.user_stats(read_attempts(spark, sf)).groupBy(sp.history_bucket(n).alias("bucket"), sp.stratum(n).alias("stratum")).agg(F.count(F.lit(1)).alias("users"))


@query("partition_summary", with_attempts("SELECT part AS partition, COUNT(*) AS n_rows, COUNT(DISTINCT uid) AS users, COUNT(*) FILTER (WHERE is_attack_ip) AS attack_rows, COUNT(DISTINCT CASE WHEN is_attack_ip THEN ip END) AS attack_ips, round(SUM(CASE WHEN is_attack_ip THEN weight ELSE 0 END) / SUM(weight), 6) AS attack_share, round(AVG(CAST(success AS DOUBLE)), 6) AS success_rate FROM weighted GROUP BY 1", 1, PART))
def partition_summary(spark, sf):
    return ql.partition_summary(ql.with_partition(read_attempts(spark, sf), CUT))


IPSTATS = "ipstats AS (SELECT ip, COUNT(*) AS attempts, COUNT(*) FILTER (WHERE success) AS successes, COUNT(DISTINCT uid) AS users FROM attempts WHERE is_attack_ip AND NOT is_ato GROUP BY 1)"


@query("attack_ip_stats", with_attempts("SELECT * FROM ipstats", 1, IPSTATS))
def attack_ip_stats(spark, sf):
    return ql.attack_ip_stats(read_attempts(spark, sf))


_FAM = "is_attack_ip AND COALESCE({}, FALSE) AS fam_{}"
FAMS = ", ".join(_FAM.format(e, k) for k, e in {
    "few_attempts": "s.attempts <= 10", "wide_spread": "s.users > 30", "dominant_network": "asn = 64503", "abroad": "COALESCE(country, '?') <> 'C0'",
    **{f"tail_network_{i}": f"asn <> 64503 AND asn % 3 = {i}" for i in range(3)}, "desktop": "device_type IN ('desktop', 'tablet')"}.items())


@query("attack_families", with_attempts(f"SELECT row_id, {FAMS} FROM attempts LEFT JOIN ipstats s USING (ip)", 1, IPSTATS))
def attack_families(spark, sf):
    a = read_attempts(spark, sf)
    out = ql.attack_families(a, ql.attack_ip_stats(a), dominant_asn=64503, home_country="C0")
    return out.select("row_id", *[c for c in out.columns if c.startswith("fam_")])


@query("ua_dimension")
def ua_dimension(spark, sf):
    return ql.ua_dimension(read_attempts(spark, sf))


@query("null_rates", with_attempts(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(AVG(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS missing FROM feats" for c in FEATURES), 1, *ALL_CTES, FEATURES_CTE))
def null_rates(spark, sf):
    return ql.null_rates(compute_features(read_attempts(spark, sf)), FEATURES)


# ------------------------------------------------------------------ aggregates

_H = "(hour(make_timestamp(t)) + minute(make_timestamp(t)) / 60.0::DOUBLE)"


@query("user_baseline", with_attempts(f"SELECT uid, COUNT(*) AS logins, round(AVG({_H}), 9) AS avg_hour, round(STDDEV_POP({_H}), 9) AS sd_hour, MIN(t) AS first_login_t FROM attempts WHERE success AND uid IS NOT NULL GROUP BY 1"))
def user_baseline(spark, sf):
    h = timefn.hour_of_day(F.col("t"))
    ok = read_attempts(spark, sf).where("success AND uid IS NOT NULL")
    return ok.groupBy("uid").agg(F.count(F.lit(1)).alias("logins"), F.round(F.avg(h), 9).alias("avg_hour"), F.round(F.stddev_pop(h), 9).alias("sd_hour"), F.min("t").alias("first_login_t"))


@query("known_devices", with_attempts("SELECT uid, substr(sha256(ua), 1, 32) AS device, MIN(t) AS first_seen, MAX(t) AS last_seen FROM attempts WHERE success AND uid IS NOT NULL AND ua IS NOT NULL GROUP BY 1, 2"))
def known_devices(spark, sf):
    ok = read_attempts(spark, sf).where("success AND uid IS NOT NULL AND ua IS NOT NULL")
    return ok.groupBy("uid", text.device_fingerprint(F.col("ua")).alias("device")).agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


@query("known_locations", with_attempts("SELECT uid, country, MIN(t) AS first_seen, MAX(t) AS last_seen FROM attempts WHERE success AND uid IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2"))
def known_locations(spark, sf):
    ok = read_attempts(spark, sf).where("success AND uid IS NOT NULL AND country IS NOT NULL")
    return ok.groupBy("uid", "country").agg(F.min("t").alias("first_seen"), F.max("t").alias("last_seen"))


@query("hour_histogram", with_attempts("SELECT uid, CAST(hour(make_timestamp(t)) AS INT) AS hour, COUNT(*) AS n FROM attempts WHERE success AND uid IS NOT NULL GROUP BY 1, 2"))
def hour_histogram(spark, sf):
    ok = read_attempts(spark, sf).where("success AND uid IS NOT NULL")
    return ok.groupBy("uid", F.floor(timefn.hour_of_day(F.col("t"))).cast("int").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "usual_values",
    with_attempts(
        """SELECT m.uid, country, asn, g.median_gap_s FROM
        (SELECT uid, (SELECT country FROM attempts b WHERE b.uid = a.uid AND success AND country IS NOT NULL GROUP BY country ORDER BY COUNT(*) DESC, MIN((t, row_id)) LIMIT 1) AS country,
          (SELECT asn FROM attempts b WHERE b.uid = a.uid AND success AND asn IS NOT NULL GROUP BY asn ORDER BY COUNT(*) DESC, MIN((t, row_id)) LIMIT 1) AS asn FROM (SELECT DISTINCT uid FROM attempts WHERE uid IS NOT NULL AND success) a) m
        LEFT JOIN (SELECT uid, round(quantile_cont((t - p) / 1000000.0::DOUBLE, 0.5), 6) AS median_gap_s FROM (SELECT uid, t, LAG(t) OVER (PARTITION BY uid ORDER BY t, row_id) AS p FROM attempts WHERE uid IS NOT NULL AND success) WHERE p IS NOT NULL GROUP BY 1) g USING (uid)"""),
)
def usual_values(spark, sf):
    from ..plans.explain import usual_profile

    return usual_profile(read_attempts(spark, sf), ["country", "asn"])


@query("quantiles", with_attempts("SELECT quantile_disc(t, 0.25) AS t_25, quantile_disc(t, 0.5) AS t_50, quantile_disc(t, 0.75) AS t_75, round(quantile_cont(CAST(t - 1704067200000000 AS DOUBLE), 0.95), 3) AS lin_95 FROM attempts"))
def quantiles(spark, sf):
    """Discrete and interpolated quantiles by rank."""
    df = read_attempts(spark, sf).select(F.lit("all").alias("g"), F.col("t"), (F.col("t") - T0).alias("x"))
    disc = exact_quantiles(df, "g", "x", [0.25, 0.5, 0.75], discrete=True)
    lin = exact_quantiles(df, "g", "x", [0.95]).select(F.col("g").alias("h"), F.col("q").alias("l"))
    both = disc.join(F.broadcast(lin), F.col("g") == F.col("h"))
    at = lambda i: (F.col("q")[i].cast("bigint") + T0)
    return both.select(at(0).alias("t_25"), at(1).alias("t_50"), at(2).alias("t_75"), F.round(F.col("l")[0], 3).alias("lin_95"))


@query("asn_reuse", with_attempts("SELECT COUNT(*) AS total, COUNT(asn) AS with_asn, CAST(COALESCE(SUM(CASE WHEN k >= 2 AND asn IS NOT NULL THEN 1 ELSE 0 END), 0) AS BIGINT) AS sharing, COUNT(DISTINCT CASE WHEN k >= 2 THEN asn END) AS asns_reused FROM (SELECT asn, COUNT(*) OVER (PARTITION BY asn) AS k FROM attempts WHERE is_ato)"))
def asn_reuse(spark, sf):
    per = read_attempts(spark, sf).where("is_ato").groupBy("asn").agg(F.count(F.lit(1)).alias("k"))
    known, reused = F.col("asn").isNotNull(), F.col("asn").isNotNull() & (F.col("k") >= 2)
    return per.agg(
        F.sum("k").alias("total"), F.coalesce(F.sum(F.when(known, F.col("k"))), F.lit(0)).alias("with_asn"),
        F.coalesce(F.sum(F.when(reused, F.col("k"))), F.lit(0)).alias("sharing"), F.count_if(reused).alias("asns_reused"))


# ------------------------------------------------------------- joins and sets


@query("sample_join", with_attempts("SELECT a.row_id, s.successes AS ip_successes FROM attempts a LEFT JOIN ipstats s USING (ip)", 1, IPSTATS))
def sample_join(spark, sf):
    from ..operators.joins import lookup

    a = read_attempts(spark, sf)
    stats = ql.attack_ip_stats(a).select(F.col("ip").alias("_ip"), F.col("successes").alias("ip_successes"))
    return lookup(a, stats, [("ip", "_ip")]).select("row_id", "ip_successes")


@query("anti_replaced", with_attempts("SELECT row_id, t FROM attempts WHERE row_id NOT IN (SELECT row_id FROM attempts WHERE is_ato)"))
def anti_replaced(spark, sf):
    a = read_attempts(spark, sf)
    return a.join(a.where("is_ato").select("row_id"), "row_id", "left_anti").select("row_id", "t")


INJECT = "inj AS (SELECT row_id + 1000000000 AS row_id, t + 1 AS t, uid, ip FROM attempts WHERE is_attack_ip)"


@query("union_injected", with_attempts("SELECT row_id, t, uid, ip FROM attempts UNION ALL SELECT * FROM inj", 1, INJECT))
def union_injected(spark, sf):
    a = read_attempts(spark, sf)
    inj = a.where("is_attack_ip").select((F.col("row_id") + 1_000_000_000).alias("row_id"), (F.col("t") + 1).alias("t"), "uid", "ip")
    return a.select("row_id", "t", "uid", "ip").unionByName(inj)


@query("union_distinct", with_attempts("SELECT row_id, t FROM attempts WHERE is_ato OR is_attack_ip"))
def union_distinct(spark, sf):
    a = read_attempts(spark, sf)
    return a.where("is_ato").unionByName(a.where("is_attack_ip")).dropDuplicates(["row_id"]).select("row_id", "t")


@query("split_overlap", with_attempts("SELECT ip FROM weighted WHERE part = 'train' AND is_attack_ip INTERSECT SELECT ip FROM weighted WHERE part = 'test' AND is_attack_ip", 1, PART))
def split_overlap(spark, sf):
    """Attack addresses in both train and test: must be empty."""
    w = ql.with_partition(read_attempts(spark, sf), CUT).where("is_attack_ip")
    return w.where("partition = 'train'").select("ip").intersect(w.where("partition = 'test'").select("ip"))


# ------------------------------------------------------------------- sampling


@query(
    "user_sample",
    with_attempts(
        """SELECT row_id, uid, stratum, sample_rate, forced FROM attempts JOIN (SELECT uid, stratum, forced, CASE WHEN forced THEN 1.0::DOUBLE WHEN stratum = 'single' THEN 0.05::DOUBLE WHEN stratum = 'light' THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END AS sample_rate
        FROM (SELECT uid, n_ato > 0 AS forced, CASE WHEN n_events = 1 THEN 'single' WHEN n_events <= 9 THEN 'light' ELSE 'heavy' END AS stratum FROM ustats)) USING (uid)
        WHERE forced OR ('0x' || substr(md5(concat(CAST(uid AS VARCHAR), ':20260920')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < sample_rate""", 1, USTATS),
)
def user_sample(spark, sf):
    """Whole histories of stratified users, drawn by a digest of their id."""
    a = read_attempts(spark, sf)
    return ql.sample_rows(a.where("uid IS NOT NULL"), ql.pick_users(ql.user_stats(a))).select("row_id", "uid", "stratum", "sample_rate", "forced")


_PICKED = """picked AS (SELECT uid, n_events FROM (SELECT uid, n_events, n_ato > 0 AS forced, CASE WHEN n_events = 1 THEN 0.05::DOUBLE WHEN n_events <= 9 THEN 0.1::DOUBLE ELSE 0.25::DOUBLE END AS rate FROM ustats)
  WHERE forced OR ('0x' || substr(md5(concat(CAST(uid AS VARCHAR), ':20260920')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate),
smp AS (SELECT p.* FROM parts p JOIN picked USING (uid)),
kept AS (SELECT *, CASE part WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS o FROM smp WHERE part IN ('train', 'val', 'test', 'late')),
bnd AS (SELECT o, MIN(t) AS lo, MAX(t) AS hi FROM kept GROUP BY 1)"""
#: From this many attempts on a user counts as too large in the check.
MEGA = 60


@query(
    "sample_invariants",
    with_attempts(
        f"""SELECT 'shared_attack_ips' AS "check", COUNT(*) AS violations FROM (SELECT ip FROM kept WHERE is_attack_ip GROUP BY 1 HAVING COUNT(DISTINCT least(o, 2)) > 1)
        UNION ALL SELECT 'missing_events', CAST(abs((SELECT COUNT(*) FROM smp) - (SELECT SUM(n_events) FROM picked)) AS BIGINT)
        UNION ALL SELECT 'time_order', COUNT(*) FROM bnd x JOIN bnd y ON x.o < y.o WHERE x.hi >= y.lo
        UNION ALL SELECT 'misplaced_takeovers', COUNT(*) FROM smp WHERE is_ato AND part <> 'ato'
        UNION ALL SELECT 'mega_users', COUNT(*) FROM picked WHERE n_events >= {MEGA}""", 1, PART, USTATS, _PICKED),
)
def sample_invariants(spark, sf):
    a = read_attempts(spark, sf)
    stats = ql.user_stats(a)
    picked = ql.pick_users(stats)
    rows = ql.with_partition(ql.sample_rows(a.where("uid IS NOT NULL"), picked), CUT)
    return ql.violations(rows, picked, stats, MEGA)


ANCHORS = """hist AS (SELECT row_id, COALESCE(SUM(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY uid ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM attempts WHERE uid IS NOT NULL),
anchors AS (SELECT a.* FROM attempts a JOIN hist USING (row_id) WHERE n >= 1 AND success AND NOT is_attack_ip AND NOT is_ato),
donors AS (SELECT * FROM attempts WHERE success AND uid IS NOT NULL)"""
_SAME = {"naive": "TRUE", "vpn": "x.country = a.country", "targeted": "x.asn = a.asn"}
_OF_ANCHOR = ("country", "ua", "browser", "os", "device_type")


def _injected(kind: str) -> str:
    number = list(KINDS).index(kind) + 1
    taken = ", ".join(f"{'a' if kind == 'targeted' and c in _OF_ANCHOR else 'd'}.{c} AS {c}" for c in ("ip", "asn", *_OF_ANCHOR))
    first = f"SELECT a.row_id AS anchor_id, arg_min(x.row_id, (x.t, x.row_id)) AS donor_id FROM anchors a JOIN donors x ON {_SAME[kind]} AND x.uid <> a.uid AND x.t > a.t AND x.t <= a.t + {DAY} GROUP BY 1"
    return f"SELECT a.row_id + {number} * 1099511627776 AS row_id, a.t AS t, a.uid AS uid, {taken}, TRUE AS success, a.row_id AS anchor_id, '{kind}' AS attacker_type, CASE WHEN d.t <= a.t + 3600000000 THEN 1 ELSE 2 END AS tier FROM ({first}) f JOIN anchors a ON a.row_id = f.anchor_id JOIN donors d ON d.row_id = f.donor_id"


@query("anchors", with_attempts("SELECT row_id, t, uid FROM anchors", 1, ANCHORS))
def anchors(spark, sf):
    """Every legitimate success with history."""
    return select_anchors(read_attempts(spark, sf), share=1.0).select("row_id", "t", "uid")


@query("counterfactual_rows", with_attempts(" UNION ALL ".join(_injected(k) for k in KINDS), 1, ANCHORS))
def counterfactual_rows(spark, sf):
    """Every anchor replaced by the attributes of the next foreign login, for each kind of attacker."""
    a = read_attempts(spark, sf)
    chosen = select_anchors(a, share=1.0)
    return reduce(DataFrame.unionByName, [donors_for(chosen, a, kind=k) for k in KINDS])


@query("counterfactual")
def counterfactual(spark, sf):
    """Features of drawn victims' replaced logins in a history without the originals; each victim meets one kind of attacker.

    The draw is the feature: were every login replaced, no history would be left to compare with.
    """
    a = read_attempts(spark, sf)
    drawn = select_anchors(a, share=0.1)
    turn = ql.uniform(F.col("row_id"), 11) * len(KINDS)
    injected = [donors_for(drawn.where(F.floor(turn) == i), a, kind=k) for i, k in enumerate(KINDS)]
    return counterfactual_features(a, reduce(DataFrame.unionByName, injected))
