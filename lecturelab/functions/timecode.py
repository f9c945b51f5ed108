"""Time codes, links and number formats as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the notes and of video addresses.
NOTE_TIMECODE = r"\\ts\{(\d{1,2}:\d{2}(?::\d{2})?)\}"
CITATION = r"\[(\d{1,2}:\d{2}(?::\d{2})?)\]"
VIDEO_ID = (
    r"(?:youtu\.be/|youtube\.com/(?:watch\?(?:.*&)?v=|embed/|shorts/|live/))([A-Za-z0-9_-]{11})"
)
DASH = "—"


def round_even(value: Column, digits: int = 0) -> Column:
    """Half-even rounding of a double."""
    scale = float(10**digits)
    return F.rint(value.cast("double") * scale) / F.lit(scale)


def _whole_seconds(seconds: Column) -> Column:
    return F.rint(F.greatest(seconds.cast("double"), F.lit(0.0))).cast("long")


def to_timecode(seconds: Column, with_hours: bool | None = None) -> Column:
    """`MM:SS`, or `H:MM:SS` when there are hours (or always / never, if asked)."""
    total = _whole_seconds(seconds)
    h = F.floor(total / 3600).cast("long")
    m = F.floor((total % 3600) / 60).cast("long")
    s = (total % 60).cast("long")
    long_form = F.format_string("%d:%02d:%02d", h, m, s)
    short_form = F.format_string("%02d:%02d", m, s)
    if with_hours is None:
        text = F.when(h > 0, long_form).otherwise(short_form)
    else:
        text = long_form if with_hours else short_form
    return F.when(seconds.isNotNull(), text)


def from_timecode(tc: Column) -> Column:
    """Seconds of one to three base-60 parts; null when the text is no time code."""
    parts = F.split(F.trim(tc), ":")
    numbers = F.transform(parts, lambda x: F.trim(x).try_cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when(F.size(parts) <= 3, total)


def video_link_prefix(source: Column) -> Column:
    video = F.regexp_extract(source, VIDEO_ID, 1)
    http = source.rlike("^https?://")
    plain = ~(source.contains("&") | source.contains("?"))
    return (
        F.when(video != "", F.concat(F.lit("https://youtu.be/"), video, F.lit("?t=")))
        .when(http & plain, F.concat(source, F.lit("?t=")))
    )


def video_link_at(source: Column, seconds: Column) -> Column:
    return F.concat(video_link_prefix(source), seconds.cast("long").cast("string"), F.lit("s"))


def is_url(source: Column) -> Column:
    return source.rlike("(?i)^https?:")


def format_duration(seconds: Column) -> Column:
    total = _whole_seconds(seconds)
    h = F.floor(total / 3600).cast("long")
    m = F.floor((total % 3600) / 60).cast("long")
    s = (total % 60).cast("long")
    return (
        F.when(seconds.isNull(), F.lit(DASH))
        .when(total < 60, F.format_string("%d с", total))
        .when(h > 0, F.format_string("%d ч %02d мин", h, m))
        .otherwise(F.format_string("%d мин %02d с", m, s))
    )


def fixed(value: Column, digits: int) -> Column:
    """Plain decimal text with `digits` places, rounded half-even."""
    return round_even(value, digits).cast(f"decimal(38,{digits})").cast("string")


def format_usd(value: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit(DASH))
        .when(value == 0, F.lit("$0"))
        .when(value < 0.01, F.concat(F.lit("$"), fixed(value, 4)))
        .otherwise(F.concat(F.lit("$"), fixed(value, 2)))
    )


def format_num(value: Column, digits: int = 2) -> Column:
    """Fixed digits without trailing zeros; `0` when nothing is left."""
    text = fixed(value, digits)
    if digits > 0:
        text = F.regexp_replace(text, r"\.?0+$", "")
    else:
        text = F.regexp_replace(text, r"0+$", "")
    return F.when(text == "", F.lit("0")).otherwise(text)


def human_size(size: Column) -> Column:
    v = size.cast("double")
    return (
        F.when(v < 1024, F.concat(fixed(v, 0), F.lit(" Б")))
        .when(v < 1024**2, F.concat(fixed(v / 1024, 0), F.lit(" КБ")))
        .when(v < 1024**3, F.concat(fixed(v / 1024**2, 1), F.lit(" МБ")))
        .otherwise(F.concat(fixed(v / 1024**3, 1), F.lit(" ГБ")))
    )


def note_timecodes(body: Column) -> Column:
    """Distinct time codes of a note in first-seen order, with seconds."""
    found = F.array_distinct(F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(NOTE_TIMECODE), F.lit(1)))
    return F.transform(found, lambda t: F.struct(t.alias("tc"), from_timecode(t).alias("seconds")))


def with_seconds(body: Column) -> Column:
    """Every bare `\\ts{12:34}` becomes `\\ts[754]{12:34}`; already expanded ones stay."""
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(NOTE_TIMECODE), F.lit(1)))
    return F.aggregate(
        found,
        body,
        lambda text, tc: F.replace(
            text,
            F.concat(F.lit("\\ts{"), tc, F.lit("}")),
            F.concat(F.lit("\\ts["), from_timecode(tc).cast("long").cast("string"), F.lit("]{"), tc, F.lit("}")),
        ),
    )
