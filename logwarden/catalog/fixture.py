"""The same attempts relation in the oracle's SQL dialect."""

from __future__ import annotations

from ..sources.attempts import GEO_POINTS


def attempts_cte(pace: int = 1) -> str:
    return f"""b AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS ts_us,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
  FROM events),
attempts AS (
  SELECT event_id AS row_id,
    1704067200000000 + ((ts_us - 1704067200000000) // {pace}) AS t,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS uid,
    CASE WHEN event_id % 7 = 0 THEN concat('ghost', CAST(user_id % 50 AS VARCHAR))
         ELSE concat('u', CAST(user_id AS VARCHAR)) END AS username,
    concat('203.0.', CAST(k % 4 AS VARCHAR), '.', CAST(k AS VARCHAR)) AS ip,
    CASE WHEN k % 13 = 0 THEN NULL WHEN event_id % 211 = 0 THEN CAST(65000 + event_id % 5 AS BIGINT)
         ELSE CAST(64500 + k % 9 AS BIGINT) END AS asn,
    CASE WHEN k % 17 = 0 THEN NULL WHEN (user_id + event_id) % 10 = 0 THEN concat('C', CAST(k % 6 AS VARCHAR))
         ELSE concat('C', CAST(user_id % 6 AS VARCHAR)) END AS country,
    CASE WHEN k % 19 = 0 THEN NULL WHEN k = 5 THEN 'curl/8.7.1'
         ELSE concat('Mozilla/5.0 ua', CAST((user_id + event_id % 3) % 12 AS VARCHAR)) END AS ua,
    CASE WHEN k % 19 = 0 THEN NULL
         ELSE concat('Chrome ', CAST(80 + (user_id + event_id % 3) % 6 AS VARCHAR), '.0.1') END AS browser,
    CASE WHEN k % 19 = 0 THEN NULL WHEN user_id % 3 = 0 THEN 'Windows 10'
         WHEN user_id % 3 = 1 THEN 'Android 10.0' ELSE 'Linux' END AS os,
    CASE WHEN k % 25 = 7 THEN 'bot' WHEN k % 19 = 0 THEN NULL
         WHEN user_id % 3 = 1 THEN 'mobile' WHEN user_id % 3 = 0 THEN 'desktop' ELSE 'tablet' END AS device_type,
    CASE WHEN event_id % 7 = 0 THEN FALSE
         WHEN k % 10 = 3 THEN event_type = 'purchase' AND event_id % 5 = 0
         ELSE event_type NOT IN ('error', 'click') END AS success,
    (k % 10 = 3) AS is_attack_ip,
    (event_id % 7 <> 0 AND event_id % 97 = 5) AS is_ato
  FROM b)"""


def geo_cte() -> str:
    rows = ", ".join(f"('{c}', {lat}::DOUBLE, {lon}::DOUBLE)" for c, lat, lon in GEO_POINTS)
    return f"geo(country, lat, lon) AS (VALUES {rows})"


def with_attempts(sql: str, pace: int = 1, *ctes: str) -> str:
    """Prefix ``sql`` with the attempts view and further CTEs."""
    return "WITH " + ",\n".join([attempts_cte(pace), *ctes]) + "\n" + sql
