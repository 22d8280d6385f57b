"""Frame indices and sample points, as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _with_ends(xs: Column, n: Column) -> Column:
    return F.when(n <= 0, F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(F.concat(xs, F.array(F.lit(0).cast("bigint"), n - 1)))))


def by_rate(frames: Column, video_fps: Column, fps: float = 1.0) -> Column:
    """Every int(video_fps / fps)-th frame, with the first and the last; 30 where the rate is unknown."""
    n = frames.cast("bigint")
    step = F.when(video_fps > 0, F.greatest(F.lit(1), F.floor(video_fps / fps))).otherwise(30).cast("bigint")
    return _with_ends(F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)), step), n)


def spread(n: Column, k: Column) -> Column:
    """k indices from 0 to n - 1, evenly spaced and rounded down; all if k >= n, the first alone if k = 1."""
    n, k = n.cast("bigint"), k.cast("bigint")
    at = lambda i: F.floor(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("bigint")
    return F.when((n <= 0) | (k <= 0), F.array().cast("array<bigint>")).when(k >= n, F.sequence(F.lit(0).cast("bigint"), F.greatest(n - 1, F.lit(0)))).otherwise(F.transform(F.sequence(F.lit(0).cast("bigint"), F.greatest(k - 1, F.lit(0))), at))


def by_count(frames: Column, count: Column) -> Column:
    return F.array_distinct(_with_ends(spread(frames, count), frames.cast("bigint")))


def share(own: Column, total: Column, most: int) -> Column:
    """Frames a clip keeps of `most` over all clips: in proportion, at least one."""
    return F.when(total <= most, own).otherwise(F.greatest(F.lit(1), F.floor(own * (most / total)))).cast("bigint")


def seconds(start: Column, end: Column) -> Column:
    """Whole seconds from start, before end."""
    s = F.sequence(F.floor(start).cast("bigint"), F.greatest(F.ceil(end), F.floor(start)).cast("bigint"))
    return F.filter(s, lambda x: (x >= start) & (x < end))
