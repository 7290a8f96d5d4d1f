"""F1-F27 as Column functions.

Each helper returns a Column built from Spark built-ins only; nothing here
runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "col_", "is_blank", "blank_to_null", "name_uuid", "stable_id", "clamp_score", "decision_for", "severity_for",
    "reasons_array", "join_reasons", "parse_int_or_zero", "parse_int_strict",
    "ban_value", "ban_value_reason", "ban_value_severity", "parse_instant",
    "severity_or_unknown", "truncate_chars", "header_last", "header_upsert", "header_upsert_many",
    "text_or_null", "header_value_str", "retry_count_from_header", "byte_length",
    "utf8", "to_ms", "from_ms", "iso_instant",
]


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1 -------------------------------------------------------------------------
# F2 / F3 ----------------------------------------------------------------------
_JAVA_BLANK = r"^\p{javaWhitespace}*$"


def is_blank(c) -> Column:
    """True for null-free strings made only of whitespace (Java's notion)."""
    return col_(c).rlike(_JAVA_BLANK)


def blank_to_null(c) -> Column:
    c = col_(c)
    return F.when(c.isNull() | is_blank(c), F.lit(None).cast("string")).otherwise(c)


# F4 ---------------------------------------------------------------------------
def name_uuid(text) -> Column:
    """Name-based (version 3, MD5) UUID of the UTF-8 bytes of ``text``."""
    h = F.md5(F.encode(col_(text), "UTF-8"))
    variant = F.lit("89ab89ab89ab89ab").substr(
        F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + F.lit(1), F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"),
        F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"),
        F.substring(h, 21, 12))


def stable_id(prefix: str, seed) -> Column:
    """Deterministic id ``uuid3(prefix + ':' + seed)``."""
    return name_uuid(F.concat(F.lit(prefix + ":"), col_(seed)))


# F5-F9 ------------------------------------------------------------------------
def clamp_score(score, cap: int = 100) -> Column:
    return F.least(col_(score), F.lit(cap))


def decision_for(score, review, block) -> Column:
    """Block test first, also when block < review (unclamped score)."""
    s = col_(score)
    review = review if isinstance(review, Column) else F.lit(review)
    block = block if isinstance(block, Column) else F.lit(block)
    return F.when(s >= block, "BLOCK").when(s >= review, "REVIEW").otherwise("ALLOW")


def severity_for(score) -> Column:
    s = col_(score)
    return F.when(s >= 95, "CRITICAL").when(s >= 90, "HIGH").otherwise("MEDIUM")


def reasons_array(pairs) -> Column:
    """``pairs`` = [(condition Column, reason str)] in rule order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for cond, name in pairs]))


def join_reasons(reasons) -> Column:
    return F.coalesce(F.array_join(col_(reasons), ","), F.lit(""))


# F10 / F11 ----------------------------------------------------------------------
_INT_RE = r"^[+-]?[0-9]+$"


def parse_int_or_zero(s, dtype: str = "int") -> Column:
    s = col_(s)
    return F.coalesce(F.when(s.rlike(_INT_RE), s.try_cast(dtype)), F.lit(0).cast(dtype))


def parse_int_strict(s, dtype: str = "int") -> Column:
    """Null when ``s`` is not a clean integer (the caller quarantines it)."""
    s = col_(s)
    return F.when(s.rlike(_INT_RE), s.try_cast(dtype))


# F12 / F13 ----------------------------------------------------------------------
def ban_value(reason, severity) -> Column:
    return F.concat(col_(reason), F.lit(":"), col_(severity).cast("string"))


_BAN_RE = r"^(.+):([^:]+)$"


def ban_value_reason(v) -> Column:
    v = col_(v)
    return F.when(v.rlike(_BAN_RE), F.regexp_extract(v, _BAN_RE, 1)).otherwise(v)


def ban_value_severity(v) -> Column:
    """Severity after the last colon; 0 when there is no usable suffix."""
    v = col_(v)
    return F.when(v.rlike(_BAN_RE), parse_int_or_zero(F.regexp_extract(v, _BAN_RE, 2))).otherwise(F.lit(0))


# F14 / F15 / F22 -----------------------------------------------------------------
def to_ms(ts) -> Column:
    return F.unix_millis(col_(ts))


def from_ms(ms) -> Column:
    return F.timestamp_millis(col_(ms))


def parse_instant(s) -> Column:
    """ISO-8601 instant (``2026-05-17T23:45:00Z``, up to nine fraction digits, of which
    six are kept) or null when unparseable."""
    s = col_(s)
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}(:?\d{2})?)$"
    return F.when(s.rlike(shape), F.try_to_timestamp(s))


def iso_instant(ts) -> Column:
    """Instant formatted like Java's ``Instant.toString`` at ms precision."""
    t = col_(ts)
    ms = F.unix_millis(t) % 1000
    return F.when(ms == 0, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


# F16 / F17 / F23 / F24 / F25 --------------------------------------------------------
def severity_or_unknown(s) -> Column:
    return F.coalesce(blank_to_null(s), F.lit("unknown"))


# F18 ---------------------------------------------------------------------------------
def truncate_chars(c, n: int = 512) -> Column:
    return F.substring(F.coalesce(col_(c), F.lit("")), 1, n)


# F19 / F20 / F21 / F26 ---------------------------------------------------------------
def utf8(s) -> Column:
    return F.encode(col_(s), "UTF-8")


def header_last(headers, key: str) -> Column:
    """Value bytes of the last header named ``key`` (null when absent)."""
    return F.try_element_at(F.filter(col_(headers), lambda h: h["key"] == F.lit(key)), F.lit(-1))["value"]


def text_or_null(b) -> Column:
    """Bytes as text; null when they aren't UTF-8."""
    return F.try_validate_utf8(col_(b).cast("string"))


def header_value_str(headers, key: str) -> Column:
    return text_or_null(header_last(headers, key))


def header_upsert(headers, key: str, value) -> Column:
    """Remove every header named ``key`` and append one with ``value``."""
    return header_upsert_many(headers, [(key, value)])


def header_upsert_many(headers, pairs) -> Column:
    """Upsert several headers in one expression (same result as upserting
    them one after another): drop all headers with those keys, append the
    new ones in order."""
    keys = [k for k, _ in pairs]
    kept = F.filter(F.coalesce(col_(headers), F.array().cast("array<struct<key:string,value:binary>>")),
                    lambda h: ~h["key"].isin(*keys))
    new = [F.struct(F.lit(k).alias("key"), utf8(v if isinstance(v, Column) else F.lit(v)).alias("value"))
           for k, v in pairs]
    return F.concat(kept, F.array(*new))


def retry_count_from_header(v, max_retries: int) -> Column:
    """Big-endian int32 of a 4-byte value, else ``max_retries + 1``."""
    v = col_(v)
    raw = F.conv(F.hex(v), 16, 10).cast("long")
    signed = F.when(raw >= F.lit(2 ** 31), raw - F.lit(2 ** 32)).otherwise(raw)
    return F.when(v.isNotNull() & (F.octet_length(v) == 4), signed.cast("int")).otherwise(
        F.lit(max_retries + 1))


def byte_length(v) -> Column:
    return F.coalesce(F.octet_length(col_(v)), F.lit(0))
