"""Scalar column functions: calendar, bins, flags, keys, ratios, threshold labels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from encore.functions import vocab


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calendar_parts(ts: str | Column) -> dict[str, Column]:
    """Calendar columns of a timestamp; Monday is day 0."""
    ts = _c(ts)
    return {
        "date": F.to_date(ts),
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
        "quarter": F.quarter(ts),
        "year": F.year(ts),
        "day_of_year": F.dayofyear(ts),
        "day_name": F.date_format(ts, "EEEE"),
        "month_name": F.date_format(ts, "MMMM"),
    }


def month_period(ts: str | Column) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def time_of_day_bins(hour: str | Column) -> Column:
    """Right-closed bins, lowest edge included: night [0,6], morning (6,12], ..."""
    h = _c(hour)
    return (
        F.when((h >= 0) & (h <= 6), "night")
        .when((h > 6) & (h <= 12), "morning")
        .when((h > 12) & (h <= 18), "afternoon")
        .when((h > 18) & (h <= 24), "evening")
    )


def time_of_day_bands(hour: str | Column) -> Column:
    """Left-closed bands: morning [6,12), afternoon [12,18), evening [18,22), else night."""
    h = _c(hour)
    return (
        F.when((h >= 6) & (h < 12), "morning")
        .when((h >= 12) & (h < 18), "afternoon")
        .when((h >= 18) & (h < 22), "evening")
        .otherwise("night")
    )


def band_flags(hour: str | Column) -> dict[str, Column]:
    band = time_of_day_bands(hour)
    return {f"is_{b}": (band == b).cast("int") for b in ("morning", "afternoon", "evening", "night")}


def weekend_flag(ts: str | Column) -> Column:
    return F.weekday(_c(ts)) >= 5


def work_hours_flag(ts: str | Column) -> Column:
    ts = _c(ts)
    return (F.weekday(ts) < 5) & (F.hour(ts) >= 9) & (F.hour(ts) < 17)


def season(month: str | Column) -> Column:
    m = _c(month)
    return (
        F.when(m.isin(12, 1, 2), "winter").when(m.isin(3, 4, 5), "spring").when(m.isin(6, 7, 8), "summer").when(
            m.isin(9, 10, 11), "fall"
        )
    )


def cyclical(x: str | Column, period: float) -> tuple[Column, Column]:
    angle = _c(x) * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def to_minutes(ms: str | Column) -> Column:
    return _c(ms) / 60000


def to_hours(ms: str | Column) -> Column:
    return _c(ms) / 3600000


def skip_flag(ms: str | Column, skipped: str | Column, floor_ms: int = 30000) -> Column:
    """Short play or an explicit skip; a missing skip flag counts as false."""
    return (_c(ms) < floor_ms) | F.coalesce(_c(skipped), F.lit(False))


def first_matching_label(
    text: str | Column,
    rules: Sequence[tuple[Sequence[str], str]],
    otherwise: str = "Other",
    missing: str = "Unknown",
) -> Column:
    """Label of the first rule one of whose substrings occurs in the lower-cased text."""
    low = F.lower(_c(text))
    out = F.when(low.isNull(), missing)
    for words, label in rules:
        hit = low.contains(words[0])
        for word in words[1:]:
            hit = hit | low.contains(word)
        out = out.when(hit, label)
    return out.otherwise(otherwise)


def platform_category(platform: str | Column) -> Column:
    return first_matching_label(platform, vocab.PLATFORM_RULES)


def reason_category(reason: str | Column) -> Column:
    return first_matching_label(reason, vocab.REASON_RULES)


def location_category(
    country: str | Column,
    ip: str | Column,
    home: Sequence[str] = vocab.VN_COUNTRIES,
    west: Sequence[str] = vocab.WESTERN_COUNTRIES,
    prefixes: Sequence[str] = vocab.VN_IP_PREFIXES,
) -> Column:
    """Country lists first, then address prefixes."""
    country, ip = _c(country), _c(ip)
    by_ip = F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: ip.startswith(p))
    return (
        F.when(country.isin(*home), "Vietnam")
        .when(country.isin(*west), "Western")
        .when(ip.isNull(), "Unknown")
        .when(by_ip, "Vietnam")
        .otherwise("Other")
    )


def uri_tail(uri: str | Column) -> Column:
    return F.element_at(F.split(_c(uri), ":"), -1)


def composite_key(*parts: str | Column, sep: str = "_", normal: bool = False) -> Column:
    """Joined key, null when any part is null; ``normal`` lower-cases and replaces blanks."""
    pieces: list[Column] = []
    for i, p in enumerate(parts):
        pieces += ([F.lit(sep)] if i else []) + [_c(p).cast("string")]
    key = F.concat(*pieces)
    return F.replace(F.lower(key), F.lit(" "), F.lit("_")) if normal else key


def tempo_category(tempo: str | Column) -> Column:
    """Right-closed bins, lowest edge included; values outside [0, 200] give null."""
    t = _c(tempo)
    return (
        F.when((t >= 0) & (t <= 90), "slow")
        .when((t > 90) & (t <= 120), "moderate")
        .when((t > 120) & (t <= 140), "fast")
        .when((t > 140) & (t <= 200), "very_fast")
    )


def when_score(cond: Column, score: str | Column) -> Column:
    """The score where the condition holds, else 0."""
    return F.when(cond, _c(score)).otherwise(F.lit(0.0))


def completion_rate(ms: str | Column, full_ms: int = 210000) -> Column:
    return F.least(F.greatest(_c(ms) / full_ms, F.lit(0.0)), F.lit(1.0))


def implicit_rating(amount: str | Column | None = None) -> Column:
    return F.lit(1.0) if amount is None else F.log1p(_c(amount))


def parse_list(text: str | Column) -> Column:
    """List literal or plain string to an array; null becomes an empty array."""
    t = _c(text)
    listed = F.from_json(F.replace(t, F.lit("'"), F.lit('"')), "array<string>")
    empty = F.array().cast("array<string>")
    return F.when(t.isNull(), empty).when(F.trim(t).startswith("["), F.coalesce(listed, empty)).otherwise(F.array(t))


def split_clean(text: str | Column, sep: str = ",") -> Column:
    """Trimmed, lower-cased, non-blank parts."""
    parts = F.transform(F.split(_c(text), sep), lambda x: F.lower(F.trim(x)))
    return F.filter(parts, lambda x: x != "")


def name_to_category(name: str | Column, categories: Mapping[str, Sequence[str]], default: str | None = None) -> Column:
    out = None
    for label, names in categories.items():
        hit = _c(name).isin(*names)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(F.lit(default))


def label_by_thresholds(x: str | Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Label of the first threshold (given from high to low) the value reaches."""
    x, out = _c(x), None
    for bound, label in steps:
        out = F.when(x >= bound, label) if out is None else out.when(x >= bound, label)
    return out.otherwise(otherwise)


# Effect-size thresholds by kind.
EFFECT_STEPS = {
    "cohens_d": [(0.8, "large"), (0.5, "medium"), (0.2, "small")],
    "correlation": [(0.5, "large"), (0.3, "medium"), (0.1, "small")],
}


def effect_size_label(x: str | Column, kind: str = "cohens_d") -> Column:
    if kind not in EFFECT_STEPS:
        return F.lit("unknown")
    return label_by_thresholds(F.abs(_c(x)), EFFECT_STEPS[kind], "negligible")


def silhouette_label(x: str | Column) -> Column:
    x = _c(x)
    return F.when(x > 0.7, "large").when(x > 0.5, "medium").when(x > 0.25, "small").otherwise("negligible")


def text_hash(*cols: str | Column, seed: int = 42) -> Column:
    """60-bit hash of the columns' texts and a seed: the first 15 hex digits of their md5, which other engines compute as well."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *texts, F.lit(str(seed))).cast("binary")), 1, 15), 16, 10).cast("long")
