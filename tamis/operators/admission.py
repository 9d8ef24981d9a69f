"""Request admission, health verdicts and validation predicates."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Documentation paths and critical components.
DOCS_PATHS = ["/docs", "/redoc", "/openapi.json"]
CRITICAL = ["database", "elasticsearch", "redis", "model"]
STATUSES = ["pending", "running", "completed", "failed"]
SEVERITIES = ["low", "medium", "high", "critical"]


def path_excluded(path: Column, excluded: list[str]) -> Column:
    """Exactly in the list, or under an entry that ends with ``*``."""
    out = path.isin([p for p in excluded]) if excluded else F.lit(False)
    for p in excluded:
        if p.endswith("*"):
            out = out | path.startswith(p[:-1])
    return out


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.split(ip, r"\.")
    octets = [F.try_element_at(parts, F.lit(i)).try_cast("int") for i in range(1, 5)]
    fine = F.size(parts) == 4
    number = F.lit(0).cast("long")
    for o in octets:
        fine = fine & o.between(0, 255)
        number = number * 256 + o
    return F.when(fine, number)


def ip_trusted(ip: Column, networks: list[str]) -> Column:
    """Whether the address lies in any of the networks (ranges of numbers, worked out before planning)."""
    n = ip_number(ip)
    out = F.lit(False)
    for net in map(ipaddress.ip_network, networks):
        if net.version == 4:
            out = out | n.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(out, F.lit(False))


def admission_verdict(within_rate: Column, path: Column, trusted: Column, has_key: Column, excluded: list[str]) -> Column:
    """The first rule that decides: rate limit, documentation, exclusion, trusted address, key."""
    docs = path.isin(DOCS_PATHS)
    for p in DOCS_PATHS:
        docs = docs | path.startswith(p + "#")
    return (
        F.when(~within_rate, "rate_limited").when(docs & trusted, "allowed_docs").when(docs, "forbidden_docs")
        .when(path_excluded(path, excluded), "allowed_excluded").when(trusted, "allowed_trusted").when(has_key, "allowed_key").otherwise("unauthorized")
    )


def health_verdict(status: DataFrame, key: list[str]) -> DataFrame:
    """(key, component, up) -> unhealthy if a critical component is down or missing, degraded if another is, else healthy."""
    critical = F.col("component").isin(CRITICAL)
    g = status.groupBy(*key).agg(F.count_distinct(F.when(critical & F.col("up"), F.col("component"))).alias("critical_up"), F.bool_and("up").alias("all_up"))
    return g.select(*key, F.when(F.col("critical_up") < len(CRITICAL), "unhealthy").when(~F.col("all_up"), "degraded").otherwise("healthy").alias("verdict"))


def key_expired(expires_at: Column, now: Column) -> Column:
    return F.coalesce(expires_at < now, F.lit(False))


def valid_email(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[^@]+@[^@]+\.[^@]+"), F.lit(False))


def valid_username(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[a-zA-Z0-9_-]+$") & F.length(x).between(3, 50), F.lit(False))


def valid_full_name(x: Column) -> Column:
    return F.coalesce(x.rlike(r"^[a-zA-ZÀ-ÿ\s-]+$") & F.length(x).between(3, 100), F.lit(False))


def valid_json_size(x: Column, most: int = 10_000) -> Column:
    return F.coalesce(F.length(x) <= most, F.lit(True))


def in_unit_range(x: Column) -> Column:
    return x.isNull() | x.between(0, 1)


def not_negative(x: Column) -> Column:
    return x.isNull() | (x >= 0)


def ensure_float(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def ensure_int(x: Column, default: int = 0) -> Column:
    return F.coalesce(x.try_cast("bigint"), F.lit(default).cast("bigint"))


def ensure_string(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))
