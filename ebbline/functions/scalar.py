"""Classification, hashing, URL, time and safe-arithmetic expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ebbline.model import TIMESTAMP_PATTERN, USER_STATUS

NULL_TOKEN = "_dbt_utils_surrogate_key_null_"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def device_category(device_type: Column | str, os: Column | str) -> Column:
    """mobile, tablet, desktop, smart_tv, bot or other; unknown for a null device, whatever the os."""
    d, o = F.lower(_c(device_type)), F.lower(_c(os))
    return (
        F.when(d.isNull(), "unknown")
        .when(d.isin("mobile", "phone", "smartphone"), "mobile")
        .when(d.isin("tablet", "ipad"), "tablet")
        .when(d.isin("desktop", "laptop", "pc"), "desktop")
        .when(d.isin("tv", "smart_tv", "console"), "smart_tv")
        .when((d == "bot") | F.coalesce(o == "bot", F.lit(False)), "bot")
        .otherwise("other")
    )


def device_from_user_agent(ua: Column | str) -> Column:
    ua = _c(ua)
    return F.when(ua.isNull(), "unknown").when(ua.rlike("iPhone|Android"), "mobile").otherwise("desktop")


def url_parameter(url: Column | str, name: str) -> Column:
    """The first non-blank value of a query parameter, decoded; null without one or with a bad escape."""
    query = F.regexp_extract(_c(url), r"^[^#?]*\?([^#]*)", 1)
    return F.try_url_decode(F.nullif(F.regexp_extract(query, rf"(?:^|&){name}=([^&]+)", 1), F.lit("")))


def utm_source(url: Column | str) -> Column:
    return url_parameter(url, "utm_source")


def pii_hash(value: Column | str, salt: str = "") -> Column:
    return F.sha2(F.concat(_c(value).cast("string"), F.lit(salt)), 256)


def anonymise_ip(ip: Column | str) -> Column:
    return F.substring(F.sha2(_c(ip), 256), 1, 16)


def surrogate_key(columns: Sequence[Column | str]) -> Column:
    return F.md5(F.concat_ws("-", *[F.coalesce(_c(c).cast("string"), F.lit(NULL_TOKEN)) for c in columns]))


def row_hash(columns: Sequence[Column | str]) -> Column:
    """md5 over values with their lengths, so that no value can run into the next; null has none."""
    text = [_c(c).cast("string") for c in columns]
    return F.md5(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]))


def user_status(code: Column | str) -> Column:
    c = _c(code)
    out = F.when(c.isNull(), "unknown")
    for short, name in USER_STATUS.items():
        out = out.when(c == short, name)
    return out.otherwise(F.lower(c))


def session_category(events: Column | str, seconds: Column | str) -> Column:
    n, s = _c(events), _c(seconds)
    return F.when(n == 1, "bounce").when(s < 30, "short").when(s < 300, "medium").when(s < 1800, "long").otherwise("very_long")


def parse_timestamp(c: Column | str, pattern: str = TIMESTAMP_PATTERN) -> Column:
    return F.try_to_timestamp(_c(c), F.lit(pattern))


def whole_seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.unix_timestamp(_c(end).cast("timestamp")) - F.unix_timestamp(_c(start).cast("timestamp"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end)) / F.lit(1_000_000.0)


def day_of_week(c: Column | str) -> Column:
    """0 is Sunday."""
    return F.dayofweek(_c(c)) - 1


def safe_ratio(numerator: Column | str, denominator: Column | str, otherwise: float = 0.0) -> Column:
    d = _c(denominator)
    return F.when(d > 0, _c(numerator) / d).otherwise(F.lit(otherwise))


def clamp_low(c: Column | str, low: float = 0.0) -> Column:
    return F.greatest(F.lit(low), _c(c))


def valid_email(c: Column | str) -> Column:
    return _c(c).rlike(r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$")


def valid_event_id(c: Column | str) -> Column:
    return _c(c).rlike(r"^[a-zA-Z0-9\-_]{8,64}$")


def truncate(c: Column | str, n: int) -> Column:
    return F.substring(_c(c), 1, n)


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(_c(end), _c(start))


def event_json(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns))


def message_key(user_id: Column | str, event_id: Column | str) -> Column:
    """The user, else the event, so that no message has a null key."""
    return F.coalesce(_c(user_id).cast("string"), _c(event_id).cast("string"), F.uuid())
