"""Scalar column expressions. Everything here stays inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from ..schema import SEVERITY_RANK

# Two-letter account prefixes and the list used for all other accounts.
BANK_BY_PREFIX = {
    "SB": "State Bank of India",
    "YS": "YES Bank",
    "AX": "Axis Bank",
    "ID": "IDFC FIRST Bank",
    "CN": "Canara Bank",
    "PN": "Punjab National Bank",
    "HD": "HDFC Bank",
    "IC": "ICICI Bank",
    "KT": "Kotak Mahindra Bank",
    "UB": "Union Bank of India",
}
BANK_BY_HASH = [
    "State Bank of India",
    "HDFC Bank",
    "ICICI Bank",
    "Axis Bank",
    "Kotak Mahindra Bank",
    "YES Bank",
    "Punjab National Bank",
    "Canara Bank",
    "Bank of Baroda",
    "IDFC FIRST Bank",
]

# Accepted timestamp layouts, tried in this order.
TIMESTAMP_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd HH:mm:ss[.SSSSSS][XXX]",
    "yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]",
    "yyyy-MM-dd",
    "yyyy/MM/dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm[XXX]",
    "yyyy-MM-dd HH:mm[XXX]",
    "yyyyMMdd'T'HHmmss[XXX]",
    "yyyyMMdd",
]

NODE_PREFIXES = ("account", "device", "ip")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def filled(c: Column | str) -> Column:
    """Null for an empty string, so that ``coalesce`` skips it."""
    return F.nullif(col(c).cast("string"), F.lit(""))


def parse_ts(c: Column | str) -> Column:
    """Timestamp from text; null when no layout fits (such rows go to quarantine).

    Digits beyond microseconds are cut, and an offset may be written without a colon.
    """
    text = F.regexp_replace(F.trim(col(c)), r"(\.\d{6})\d+", "$1")
    text = F.regexp_replace(text, r"(\d[T ]?\d{2}:?\d{2}(?::?\d{2})?(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in TIMESTAMP_FORMATS])


def ensure_utc(c: Column | str, zone: Column | str | None = None) -> Column:
    """Instant in UTC: a wall-clock value read in ``zone``, or already UTC when none is given."""
    return col(c) if zone is None else F.to_utc_timestamp(col(c), zone)


def number(c: Column | str) -> Column:
    """Double, or null for blank and malformed text."""
    return F.trim(col(c).cast("string")).try_cast("double")


def sanitize(c: Column | str, default: float = 0.0) -> Column:
    """Finite double from any value: null, text, NaN and infinities become ``default``."""
    return finite(number(c), default)


def finite(c: Column | str, default: float = 0.0) -> Column:
    """The same for a numeric column. NaN sorts above infinity, so one comparison covers both."""
    return F.coalesce(F.when(F.abs(col(c)) < float("inf"), col(c).cast("double")), F.lit(float(default)))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def ratio(c: Column, d: Column) -> Column:
    """Quotient of two doubles as IEEE 754 has it, and as the SQL does: a divisor of zero gives an infinity, or NaN for zero by zero."""
    nothing = F.when(c > 0, float("inf")).when(c < 0, float("-inf")).when(c == 0, float("nan"))
    return F.when(d == 0, nothing).otherwise(c / F.nullif(d, F.lit(0.0)))


def micros(c: Column | str) -> Column:
    return F.unix_micros(col(c))


def ts_text(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def iso(c: Column | str) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def money(c: Column | str) -> Column:
    return F.format_number(col(c), 2)


def mask_account(c: Column | str) -> Column:
    c = col(c)
    return F.when(F.length(c) <= 4, c).otherwise(F.concat(F.lit("XXXX"), F.substring(c, -4, 4)))


def format_inr(c: Column | str) -> Column:
    return F.concat(F.lit("₹"), money(c))


def md5_mod10(c: Column | str) -> Column:
    """md5 as a 128-bit number modulo 10, from parts of 15, 15 and 2 hex digits (16^n mod 10 = 6)."""
    digest = F.md5(col(c).cast("binary"))
    part = lambda start, n: F.conv(F.substring(digest, start, n), 16, 10).cast("long") % 10
    return (((part(1, 15) + part(16, 15)) * 6 + part(31, 2)) % 10).cast("int")


def map_bank(c: Column | str) -> Column:
    """Bank of an account: by prefix, else by hash. Both tables are constants in the plan."""
    account = F.trim(col(c).cast("string"))
    by_prefix = F.create_map(*[F.lit(x) for kv in BANK_BY_PREFIX.items() for x in kv])
    by_hash = F.array(*[F.lit(b) for b in BANK_BY_HASH])
    prefix = F.upper(F.substring(account, 1, 2))
    return F.coalesce(F.try_element_at(by_prefix, prefix), F.element_at(by_hash, md5_mod10(account) + 1))


def hmac_sha256(c: Column | str, key: str) -> Column:
    """Keyed hash from two nested sha2 calls; the padded keys are literals. Key from configuration."""
    raw = key.encode()
    if not raw or len(raw) > 64:
        raise ValueError("key must have 1 to 64 bytes")
    padded = raw.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in padded), bytes(b ^ 0x5C for b in padded)
    first = F.sha2(F.concat(F.lit(bytearray(inner)), col(c).cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)


def strip_prefix(c: Column | str) -> Column:
    return F.regexp_replace(F.trim(col(c)), "^(account|device|ip):", "")


def node_id(c: Column | str, kind: str) -> Column:
    """Typed node id; an id that already has the prefix is kept."""
    if kind not in NODE_PREFIXES:
        raise ValueError(f"unknown node type {kind!r}")
    c = F.trim(col(c))
    return F.when(c.startswith(f"{kind}:"), c).otherwise(F.concat(F.lit(f"{kind}:"), c))


def severity_rank(c: Column | str) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(ranks, col(c)), F.lit(0))


def severity_name(c: Column | str) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in SEVERITY_RANK.items() for x in (v, k)])
    return F.element_at(names, col(c))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a1, o1, a2, o2 = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def joined(parts: list[Column], sep: str = " ") -> Column:
    return F.concat_ws(sep, *parts)
