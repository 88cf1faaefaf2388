"""Scalar rules over outcomes, scores, time and videos, as column expressions.

Null in, null out unless a function says otherwise: an unknown is neither zero nor a bucket of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, bounds and weights that results depend on.
QUESTION_WORDS = ("who", "what", "when", "where", "why", "how", "which", "is", "are", "can", "did", "does", "do")
SUPERLATIVES = (
    "best", "worst", "most", "least", "only", "greatest", "biggest", "fastest", "never", "always", "ever", "perfect",
    "incredible", "unbelievable",
)
NEGATIONS = ("not", "no", "never", "without", "nobody", "nothing", "cannot")
RUBRIC = {"hook": (25, 0.25), "curiosity": (20, 0.20), "standalone": (20, 0.20), "emotion": (15, 0.15), "pacing": (10, 0.10), "shareability": (10, 0.10)}
RESTATED_DAYS = 3
MIN_CONCLUSION = 20


def _words(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def clamp(value: Column, low, high) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def hook_type(hook: Column) -> Column:
    """NONE, QUESTION, QUOTE, SUPERLATIVE, NUMBER, NEGATION or STATEMENT; the first that holds."""
    text = F.trim(hook)
    words = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[\p{L}\p{N}_']+"), F.lit(0))
    edges = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "NONE")
        .when(text.endswith("?") | F.coalesce(F.try_element_at(words, F.lit(1)).isin(*QUESTION_WORDS), F.lit(False)), "QUESTION")
        .when(edges.isin('""', "''", "“”"), "QUOTE")
        .when(F.arrays_overlap(words, _words(SUPERLATIVES)), "SUPERLATIVE")
        .when(text.rlike(r"(?U)\d"), "NUMBER")
        .when(F.arrays_overlap(words, _words(NEGATIONS)), "NEGATION")
        .otherwise("STATEMENT")
    )


def duration_bucket(seconds: Column) -> Column:
    return (
        F.when(seconds.isNull() | (seconds <= 0), None)
        .when(seconds < 15, "<15s").when(seconds < 30, "15-30s").when(seconds < 45, "30-45s").when(seconds <= 60, "45-60s")
        .otherwise(">60s")
    )


def score_band(total: Column) -> Column:
    return (
        F.when(total.isNull(), None)
        .when(total < 60, "<60").when(total < 70, "60-69").when(total < 80, "70-79").when(total < 90, "80-89")
        .otherwise("90+")
    )


def posting_band(at: Column) -> Column:
    """A four-hour band of the session's zone, which is UTC."""
    start = F.floor(F.hour(at) / 4) * 4
    return F.when(at.isNotNull(), F.concat(F.lpad(start.cast("string"), 2, "0"), F.lit("-"), F.lpad((start + 4).cast("string"), 2, "0"), F.lit(" UTC")))


def first_topic(tags: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""), F.lit(1))


def is_partial(day: Column, today: Column) -> Column:
    """Days that may still be restated."""
    return F.datediff(today, day) <= RESTATED_DAYS


def local_day(at: Column, zone: str = "America/Los_Angeles") -> Column:
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone))


def total_score(sub: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """0 to 100: each sub-score over its own maximum, weighted; half rounds to even."""
    parts = [sub[k].cast("double") / most * F.lit((weights or {}).get(k, w)) for k, (most, w) in RUBRIC.items()]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return clamp(F.bround(total * 100, 0).cast("int"), 0, 100)


def iou_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    shared = F.least(a1, b1) - F.greatest(a0, b0)
    union = (a1 - a0) + (b1 - b0) - shared
    return F.when((shared <= 0) | (union <= 0), 0.0).otherwise(shared / union)


def rect_overlap(a: tuple[Column, ...], b: tuple[Column, ...], threshold: float = 0.30) -> Column:
    """Rectangles (x, y, w, h): shared area over the smaller area."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    smaller = F.least(a[2] * a[3], b[2] * b[3])
    return F.when((w <= 0) | (h <= 0) | (smaller <= 0), False).otherwise(w * h / smaller >= threshold)


def timecode(seconds: Column) -> Column:
    """m:ss, with tenths where there are any and a sign where it is negative."""
    tenths = F.bround(F.abs(seconds) * 10, 0).cast("long")
    base = F.format_string("%d:%02d", F.floor(tenths / 600), F.floor(F.pmod(tenths, F.lit(600)) / 10))
    rest = F.pmod(tenths, F.lit(10))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), base, F.when(rest == 0, "").otherwise(F.concat(F.lit("."), rest.cast("string"))))


def strength_traffic(searches: Column) -> Column:
    return F.when(searches > 0, clamp((F.log10(searches.cast("double")) - 3.5) / 3, 0.0, 1.0)).otherwise(0.0)


def strength_velocity(rate: Column) -> Column:
    return F.when(rate > 0, clamp((F.log10(rate.cast("double")) - 1) / 3.5, 0.0, 1.0)).otherwise(0.0)


def views_per_hour(views: Column, age_hours: Column) -> Column:
    return views / F.greatest(age_hours, F.lit(1.0))


def score_video(views: Column, age_hours: Column, seconds: Column, longest: float) -> Column:
    """0 to 100: speed 40, recency 20, length 25, views 15; what is unknown scores in the middle."""
    rate = views_per_hour(views, age_hours)
    speed = F.when(rate.isNull(), 15.0).otherwise(40.0 * strength_velocity(rate))
    age = F.greatest(age_hours, F.lit(0.0))
    recent = F.when(age_hours.isNull(), 8.0).when(age <= 24, 20.0).when(age <= 72, 14.0).when(age <= 168, 8.0).otherwise(2.0)
    length = F.when(seconds.isNull(), 12.0).when(seconds > longest, 0.0).when(seconds >= 60, 25.0).when(seconds >= 20, 15.0).otherwise(5.0)
    digits = F.length(F.coalesce(views, F.lit(0)).cast("string"))
    seen = F.when(views > 0, 15.0 * F.least(F.lit(1.0), (digits - 1) / 7.0)).otherwise(0.0)
    return F.bround(F.least(F.lit(100.0), speed + recent + length + seen), 0).cast("int")


def blend_rank(score: Column, relevance: Column, worth: Column) -> Column:
    blended = F.when(relevance.isNull(), score.cast("double")).otherwise(0.6 * score + 4.0 * relevance)
    return clamp(F.bround(F.when(worth, blended).otherwise(blended * 0.6), 0), 0.0, 100.0).cast("int")


def fisher_interval(r: Column, n: Column, spearman: bool = True) -> tuple[Column, Column]:
    """A 95% interval by Fisher's z; null below four pairs or where |r| is 1."""
    known = (n >= 4) & (r > -1) & (r < 1)
    half = F.lit(1.96 * (1.06 if spearman else 1.0)) / F.sqrt(n - 3)
    return F.when(known, F.tanh(F.atanh(r) - half)), F.when(known, F.tanh(F.atanh(r) + half))


def interpretation(r: Column, n: Column, low: Column, high: Column) -> Column:
    """Words that n and the interval decide, never the coefficient alone."""
    span = F.format_string("[%.2f, %.2f]", low, high)
    strength = F.when(F.abs(r) < 0.3, "weak").when(F.abs(r) < 0.6, "moderate").otherwise("strong")
    return (
        F.when(n < 2, F.format_string("n=%d: nothing to correlate.", n))
        .when(r.isNull(), "Undefined: a side has no variation.")
        .when(n < MIN_CONCLUSION, F.format_string("n=%d: too few for a conclusion.", n))
        .when(low.isNull(), F.format_string("n=%d: no interval, no conclusion.", n))
        .when((low <= 0) & (high >= 0), F.format_string("%s contains zero: no relation shown.", span))
        .otherwise(F.format_string("A %s relation, %s, %s.", strength, F.when(r > 0, "higher").otherwise("lower"), span))
    )


def retention_at(curve: Column, point: float = 0.5) -> Column:
    """A curve of (x, y) structs interpolated at a point, held at its ends; null for an empty curve."""
    ordered = F.array_sort(curve)
    first, last = F.try_element_at(ordered, F.lit(1)), F.try_element_at(ordered, F.lit(-1))
    pairs = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    span = F.try_element_at(F.filter(pairs, lambda p: p.b.isNotNull() & (p.a.x <= point) & (p.b.x >= point)), F.lit(1))
    weight = (F.lit(point) - span.a.x) / F.nullif(span.b.x - span.a.x, F.lit(0.0))
    inside = F.when(span.b.x == span.a.x, span.a.y).otherwise(span.a.y + weight * (span.b.y - span.a.y))
    return F.when(F.size(ordered) < 1, None).when(F.lit(point) <= first.x, first.y).when(F.lit(point) >= last.x, last.y).otherwise(inside)
