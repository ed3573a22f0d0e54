"""The nineteen rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions.geo import haversine_km
from ..functions.timefn import DAY, HOUR
from ..operators.sequence import gap_cv, mean_gap_s
from .rules import REPUTATION, Ask, Finding, Param, rule

GUESSING = "password guessing"
AUTOMATION = "automation"
CONTEXT = "account context"
DAY_S = 86_400

# Lower-case user-agent fragments of scripted clients.
SCRIPT_MARKERS = (
    "curl/", "wget/", "python-requests", "python-urllib", "python-httpx", "aiohttp", "go-http-client", "libwww-perl", "java/", "apache-httpclient",
    "postmanruntime", "insomnia", "axios/", "node-fetch", "undici", "scrapy", "hydra", "sqlmap", "nikto", "nmap", "masscan",
    "headlesschrome", "phantomjs", "selenium", "playwright", "puppeteer",
)

failed = lambda: ~F.col("success")


# Fixed values in all rules below: defaults and ranges of the parameters, severities, techniques and modes.


@rule(
    id="brute_force", category=GUESSING, severity="high", techniques=["T1110.001"], title="Many failures on one name",
    params={"threshold": Param(5, 2, 1000), "window_s": Param(300, 10, DAY_S)},
)
def brute_force(ask: Ask, p) -> Finding:
    fails = ask.count("username", "fail", p.window_s)
    return Finding(failed() & (fails >= p.threshold), {"fails": fails})


@rule(
    id="credential_stuffing", category=GUESSING, severity="high", techniques=["T1110.004"], title="Many names from one address or network",
    params={
        "window_s": Param(300, 10, DAY_S), "min_fails": Param(10, 2, 100_000), "min_users": Param(5, 2, 100_000),
        "max_success_ratio": Param(0.5, 0.0, 1.0), "asn_min_fails": Param(40, 2, 1_000_000), "asn_min_users": Param(20, 2, 1_000_000),
        "ua_rotation_min": Param(4, 2, 1000), "ua_rotation_relax": Param(0.5, 0.1, 1.0),
    },
)
def credential_stuffing(ask: Ask, p) -> Finding:
    w = p.window_s

    def scope(key, min_fails, min_users):
        fails = ask.count(key, "fail", w)
        users = ask.distinct(key, "username", "fail", w)
        oks = ask.count(key, "ok", w)
        return (fails >= min_fails) & (users >= min_users) & (oks <= F.lit(p.max_success_ratio) * (oks + fails)), fails, users, oks

    rotating = ask.distinct("ip", "ua_hash", "fail", w) >= p.ua_rotation_min
    relax = F.when(rotating, p.ua_rotation_relax).otherwise(1.0)
    by_ip, fails, users, oks = scope("ip", F.lit(p.min_fails) * relax, F.lit(p.min_users) * relax)
    by_asn, asn_fails, asn_users, asn_oks = scope("asn", F.lit(p.asn_min_fails), F.lit(p.asn_min_users))
    by_ip, by_asn = F.coalesce(by_ip, F.lit(False)), F.coalesce(by_asn, F.lit(False))
    return Finding(
        failed() & (by_ip | by_asn),
        {
            "fails": F.when(by_ip, fails).otherwise(asn_fails),
            "distinct_users": F.when(by_ip, users).otherwise(asn_users),
            "successes": F.when(by_ip, oks).otherwise(asn_oks),
            "rotating_user_agent": F.when(by_ip, rotating),
        },
        F.when(by_ip, "ip").otherwise("asn"),
    )


@rule(
    id="password_spray_slow", category=GUESSING, severity="high", techniques=["T1110.003"], title="Few tries on many names, slowly",
    params={
        "window_s": Param(DAY_S, 600, DAY_S), "min_users": Param(15, 3, 100_000), "max_fails_per_user": Param(3.0, 1.0, 100.0),
        "max_fails_per_hour": Param(120, 1, 100_000), "asn_min_users": Param(40, 3, 1_000_000), "asn_max_fails_per_hour": Param(600, 1, 1_000_000),
    },
)
def password_spray_slow(ask: Ask, p) -> Finding:
    def scope(key, min_users, per_hour):
        users = ask.distinct(key, "username", "fail", p.window_s)
        fails = ask.count(key, "fail", p.window_s)
        hourly = ask.count(key, "fail", 3600)
        return (users >= min_users) & (fails <= F.lit(p.max_fails_per_user) * users) & (hourly <= per_hour), users, fails, hourly

    by_ip, users, fails, hourly = scope("ip", p.min_users, p.max_fails_per_hour)
    by_asn, asn_users, asn_fails, asn_hourly = scope("asn", p.asn_min_users, p.asn_max_fails_per_hour)
    by_ip, by_asn = F.coalesce(by_ip, F.lit(False)), F.coalesce(by_asn, F.lit(False))
    return Finding(
        failed() & (by_ip | by_asn),
        {
            "distinct_users": F.when(by_ip, users).otherwise(asn_users),
            "fails": F.when(by_ip, fails).otherwise(asn_fails),
            "fails_last_hour": F.when(by_ip, hourly).otherwise(asn_hourly),
        },
        F.when(by_ip, "ip").otherwise("asn"),
    )


@rule(
    id="distributed_bruteforce", category=GUESSING, severity="high", techniques=["T1110.001", "T1090"], title="One name guessed from many addresses",
    params={"window_s": Param(3600, 60, DAY_S), "min_fails": Param(8, 2, 100_000), "min_ips": Param(5, 2, 100_000)},
)
def distributed_bruteforce(ask: Ask, p) -> Finding:
    fails = ask.count("username", "fail", p.window_s)
    ips = ask.distinct("username", "ip", "fail", p.window_s)
    return Finding(failed() & (fails >= p.min_fails) & (ips >= p.min_ips), {"fails": fails, "distinct_ips": ips})


@rule(
    id="username_enumeration", category=GUESSING, severity="medium", techniques=["T1589"], title="Many unknown names from one address",
    params={"window_s": Param(600, 10, DAY_S), "min_usernames": Param(8, 2, 100_000)},
)
def username_enumeration(ask: Ask, p) -> Finding:
    names = ask.distinct("ip", "username", "fail_unknown", p.window_s)
    return Finding(failed() & F.col("user_key").isNull() & (names >= p.min_usernames), {"distinct_unknown_usernames": names})


@rule(
    id="success_after_failures", category=GUESSING, severity="high", techniques=["T1110.001"], needs=["account"], title="Success right after failures",
    params={"window_s": Param(600, 10, DAY_S), "min_fails": Param(5, 2, 100_000)},
)
def success_after_failures(ask: Ask, p) -> Finding:
    fails = ask.count("username", "fail", p.window_s)
    ips = ask.distinct("username", "ip", "fail", p.window_s)
    return Finding(F.col("success") & (fails >= p.min_fails), {"fails_before": fails, "distinct_ips_before": ips})


@rule(id="bot_user_agent", category=AUTOMATION, severity="low", techniques=["T1110"], title="Bot user agent")
def bot_user_agent(ask: Ask, p) -> Finding:
    return Finding(F.col("device_type") == "bot", {"user_agent": F.trim(F.coalesce(F.col("ua"), F.lit("")))})


@rule(
    id="scripted_client", category=AUTOMATION, severity="medium", techniques=["T1110"], title="Scripted client or no user agent",
    params={"markers": Param(SCRIPT_MARKERS), "flag_empty_ua": Param(True)},
)
def scripted_client(ask: Ask, p) -> Finding:
    ua = F.trim(F.coalesce(F.col("ua"), F.lit("")))
    lowered = F.lower(ua)
    first = F.coalesce(*[F.when(lowered.contains(m), F.lit(m)) for m in p.markers]) if p.markers else F.lit(None).cast("string")
    marker = F.when(ua == "", F.lit("(empty)") if p.flag_empty_ua else F.lit(None)).otherwise(first)
    return Finding(marker.isNotNull(), {"marker": marker, "user_agent": ua})


@rule(
    id="ua_rotation", category=AUTOMATION, severity="medium", techniques=["T1110.004"], needs=["user_agent"], title="Many user agents from one address",
    params={"window_s": Param(600, 10, DAY_S), "min_distinct_ua": Param(5, 2, 1000), "min_fails": Param(8, 2, 100_000)},
)
def ua_rotation(ask: Ask, p) -> Finding:
    fails = ask.count("ip", "fail", p.window_s)
    agents = ask.distinct("ip", "ua_hash", "fail", p.window_s)
    return Finding(failed() & (fails >= p.min_fails) & (agents >= p.min_distinct_ua), {"fails": fails, "distinct_user_agents": agents})


@rule(
    id="regular_rhythm", category=AUTOMATION, severity="medium", techniques=["T1110"], mode="shadow", title="Failures at an even pace",
    params={"samples": Param(10, 5, 100), "max_mean_interval_s": Param(30.0, 0.0, 3600.0), "max_cv": Param(0.15, 0.0, 1.0)},
)
def regular_rhythm(ask: Ask, p) -> Finding:
    times = ask.last_fails(p.samples)
    mean, cv = mean_gap_s(times), gap_cv(times)
    return Finding(
        failed() & (F.size(times) >= p.samples) & (mean <= p.max_mean_interval_s) & (cv <= p.max_cv),
        {"mean_interval_s": F.round(mean, 3), "cv": F.round(cv, 4)},
    )


@rule(
    id="impossible_travel", category=CONTEXT, severity="high", techniques=["T1078"], needs=["account", "geo", "history"], title="Travel faster than an airliner",
    params={"max_speed_kmh": Param(900.0, 100.0, 20_000.0)},
)
def impossible_travel(ask: Ask, p) -> Finding:
    ask.want("history")
    prev = F.col("prev")
    hours = (F.col("t") - prev["t"]) / F.lit(float(HOUR))
    km = haversine_km(prev["lat"], prev["lon"], F.col("lat"), F.col("lon"))
    speed = F.when(hours > 0, km / hours)
    return Finding(speed > p.max_speed_kmh, {"distance_km": F.round(km, 1), "elapsed_minutes": F.round(hours * 60, 2), "speed_kmh": F.round(speed, 1)})


@rule(
    id="multi_context_simultaneous", category=CONTEXT, severity="high", techniques=["T1078"], needs=["account", "country"], title="Successes from several countries at once",
    params={"window_s": Param(600, 10, DAY_S), "min_countries": Param(2, 2, 50)},
)
def multi_context_simultaneous(ask: Ask, p) -> Finding:
    n = ask.distinct("user_key", "country", "ok", p.window_s)
    return Finding(F.col("success") & (n >= p.min_countries), {"countries": n})


@rule(
    id="country_hop", category=CONTEXT, severity="medium", techniques=["T1078", "T1090"], needs=["country"], mode="shadow", title="One name tried from several countries",
    params={"window_s": Param(DAY_S, 600, 7 * DAY_S), "min_countries": Param(3, 2, 50)},
)
def country_hop(ask: Ask, p) -> Finding:
    n = ask.distinct("username", "country", "any", p.window_s)
    return Finding(n >= p.min_countries, {"distinct_countries": n})


@rule(
    id="dormant_account_login", category=CONTEXT, severity="medium", techniques=["T1078"], needs=["account", "history"], title="Dormant account wakes up",
    params={"dormant_days": Param(90, 1, 3650), "require_change": Param(True)},
)
def dormant_account_login(ask: Ask, p) -> Finding:
    ask.want("history")
    idle = (F.col("t") - F.col("last_success_t")) / F.lit(float(DAY))
    new_country = F.coalesce((F.col("country") != "") & (F.col("country_seen") == 0), F.lit(False))
    new_device = F.coalesce((F.col("ua_hash") != "") & (F.col("device_seen") == 0), F.lit(False))
    changed = (new_country | new_device) if p.require_change else F.lit(True)
    return Finding(
        F.col("success") & (idle >= p.dormant_days) & changed,
        {"idle_days": F.round(idle, 1), "new_country": new_country, "new_device": new_device},
    )


@rule(
    id="rare_network_login", category=CONTEXT, severity="medium", techniques=["T1078"], needs=["account", "asn", "global_stats"], mode="shadow", title="Success from a rare network",
    params={"max_share": Param(2e-5, 0.0, 0.01), "min_total": Param(20_000, 100, 100_000_000)},
)
def rare_network_login(ask: Ask, p) -> Finding:
    ask.want("global_stats")
    share = F.col("stat_asn") / F.col("stat_total")
    return Finding(
        F.col("success") & (F.col("stat_total") >= p.min_total) & (share <= p.max_share),
        {"asn_successes": F.col("stat_asn"), "total_successes": F.col("stat_total")},
    )


def _listed(name: str):
    def build(ask: Ask, p) -> Finding:
        ask.want(f"list:{name}")
        return Finding(F.col(f"in_{name}"), {"list": F.lit(name)})

    return build


rule(id="tor_exit", category=REPUTATION, severity="medium", techniques=["T1090.003"], needs=["tor_list"], title="Tor exit")(_listed("tor"))
rule(
    id="datacenter_ip", category=REPUTATION, severity="low", techniques=["T1090.002"], needs=["datacenter_list"], mode="shadow", title="Hosting network"
)(_listed("datacenter"))
rule(id="vpn_ip", category=REPUTATION, severity="low", techniques=["T1090"], needs=["vpn_list"], mode="shadow", title="Commercial VPN")(_listed("vpn"))


@rule(id="blocklist_hit", category=REPUTATION, severity="high", title="Blocked address, network or name")
def blocklist_hit(ask: Ask, p) -> Finding:
    ask.want("blocklist")
    block = F.col("block")
    return Finding(block.isNotNull(), {"kind": block["kind"], "value": block["value"]}, block["kind"])
