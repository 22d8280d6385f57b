"""Time keys of the activity clock: nine digits DHHMMSSFF, day 1 to 9 and frames of 1/30 second.

Columns in, columns out; malformed input gives null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FPS, DAY = 30, 86_400


def parse_key(key: Column) -> Column:
    """struct(day, hour, minute, second, frame) of a key, padded to nine digits; null if a field is out of range."""
    k = F.lpad(key.cast("string"), 9, "0")
    f = [F.substring(k, a, n).try_cast("int") for a, n in ((1, 1), (2, 2), (4, 2), (6, 2), (8, 2))]
    ok = (F.length(key.cast("string")) <= 9) & f[0].between(1, 9) & f[1].between(0, 23) & f[2].between(0, 59) & f[3].between(0, 59) & f[4].between(0, FPS - 1)
    return F.when(ok, F.struct(*(x.alias(n) for x, n in zip(f, ("day", "hour", "minute", "second", "frame"), strict=True))))


def from_day_clock(day: Column, clock: Column) -> Column:
    """Key of ("DAY3", HHMMSSFF), the clock padded to eight digits."""
    return F.concat(F.regexp_extract(day, r"(\d+)$", 1), F.lpad(clock.cast("string"), 8, "0"))


def key_seconds(key: Column) -> Column:
    p = parse_key(key)
    return (p["day"] - 1) * DAY + p["hour"] * 3600 + p["minute"] * 60 + p["second"] + p["frame"] / F.lit(float(FPS))


def seconds_key(seconds: Column) -> Column:
    """Key of seconds since day 1; frames round half to even and may carry."""
    frames = F.bround(seconds * FPS).cast("bigint")
    s = F.floor(frames / FPS).cast("bigint")
    part = lambda x, n: F.lpad(x.cast("bigint").cast("string"), n, "0")
    return F.concat((F.floor(s / DAY) + 1).cast("bigint").cast("string"), part(F.floor(s % DAY / 3600), 2), part(F.floor(s % 3600 / 60), 2), part(s % 60, 2), part(frames % FPS, 2))


def human(key: Column) -> Column:
    p = parse_key(key)
    return F.when(p.isNotNull(), F.format_string("DAY%d %02d:%02d:%02d", p["day"], p["hour"], p["minute"], p["second"]))


def clock_seconds(clock: Column) -> Column:
    """Seconds of HHMMSS; hours may pass 24, minutes and seconds may not pass 59."""
    c = F.lpad(clock.cast("string"), 6, "0")
    h, m, s = (F.substring(c, a, 2).try_cast("int") for a in (1, 3, 5))
    return F.when((m <= 59) & (s <= 59), h * 3600 + m * 60 + s)


def frame_clock_seconds(clock: Column) -> Column:
    """Seconds of the day of HHMMSSFF; frames do not count."""
    c = clock.cast("bigint")
    return (F.floor(c / 1_000_000) * 3600 + F.floor(c / 10_000) % 100 * 60 + F.floor(c / 100) % 100).cast("bigint")


def seconds_frame_clock(seconds: Column) -> Column:
    """HHMMSSFF of seconds of the day, frame 0."""
    s = seconds.cast("bigint")
    return (F.floor(s / 3600) * 1_000_000 + F.floor(s % 3600 / 60) * 10_000 + s % 60 * 100).cast("bigint")


def srt_clock(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS,mmm."""
    ms = F.bround(seconds * 1000).cast("bigint")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3600000).cast("bigint"), F.floor(ms % 3600000 / 60000).cast("bigint"), F.floor(ms % 60000 / 1000).cast("bigint"), ms % 1000)


def roll_over(clock: Column) -> Column:
    """HHMMSS with seconds and minutes of 60 or more carried on."""
    s = F.floor(clock / 10000) * 3600 + F.floor(clock / 100) % 100 * 60 + clock % 100
    return (F.floor(s / 3600) * 10000 + F.floor(s % 3600 / 60) * 100 + s % 60).cast("bigint")


def time_range(text: Column) -> Column:
    """struct(start, end) as integer keys of "DAY1 11:09:43 - DAY1 11:09:58"; null without two times."""
    at = r"(?i)DAY\s*(\d+)\s+(\d{1,2}):(\d{2}):(\d{2})"
    part = lambda i: F.regexp_extract_all(text, F.lit(at), i)
    key = lambda n: F.concat(F.get(part(1), F.lit(n)), F.lpad(F.get(part(2), F.lit(n)), 2, "0"), F.get(part(3), F.lit(n)), F.get(part(4), F.lit(n)), F.lit("00")).try_cast("bigint")
    return F.when(F.size(part(1)) >= 2, F.struct(key(0).alias("start"), key(1).alias("end")))


def target_times(date: Column, time: Column, times: Column) -> Column:
    """array of struct(start, end) keys: a range HHMMSSFFDAYd_HHMMSSFF, one time, or a list; single times have start = end."""
    day = F.regexp_replace(date, "(?i)day", "")
    key = lambda d, t: F.concat(d, F.lpad(t, 8, "0")).try_cast("bigint")
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    g = [F.regexp_extract(time, r"(?i)^(\d+)DAY(\d+)_(\d+)$", i) for i in (1, 2, 3)]
    got = F.when(g[0] != "", F.array(span(key(day, g[0]), key(g[1], g[2])))).when(F.length(time) > 0, F.array(span(key(day, time), key(day, time))))
    got = F.coalesce(got, F.transform(times, lambda t: span(key(day, t), key(day, t))))
    return F.filter(got, lambda x: x["start"].isNotNull() & x["end"].isNotNull())


def file_clock(name: Column) -> Column:
    """struct(day, clock) of a file name such as DAY1_A1_JAKE_11094208.mp4; null parts where it has none."""
    part = lambda p: F.nullif(F.regexp_extract(name, p, 1), F.lit(""))
    return F.struct(part(r"(?i)(DAY\d+)").alias("day"), part(r"(\d{8})(?=\.\w+$|$)").alias("clock"))
