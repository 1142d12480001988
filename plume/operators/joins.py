"""Joins.

No side is force-broadcast: the planner broadcasts a side whose size it knows
to be small, and with AQE on, a shuffled side that turns out small is switched
to a broadcast at runtime and skewed partitions are split
(``spark.sql.adaptive.skewJoin.enabled``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame

SUFFIXES = ("_comment", "_video")


def integrate_videos(comments: DataFrame, videos: DataFrame, key: str = "videoId") -> DataFrame:
    """Comments left-joined with per-video engagement.

    Unmatched comments keep null engagement (cleaning turns it into 0).  A
    video holding a third of all comments is no problem in the broadcast form;
    in the shuffle form AQE splits the skewed partition.
    """
    return comments.join(videos, key, "left")


def integrate_raw(comments: DataFrame, videos: DataFrame, key: str = "videoId",
                  suffixes: tuple[str, str] = SUFFIXES) -> DataFrame:
    """Raw comments left-joined with raw videos, which may share column names.

    The key appears once; a column that both sides have (names compare without
    case) gets its side's suffix on both, before the join.  A suffixed name that
    is taken already, or a missing key, is an error."""
    sides = [(comments, suffixes[0]), (videos, suffixes[1])]
    names = [{c.lower() for c in df.columns} - {key.lower()} for df, _ in sides]
    for (df, _), own in zip(sides, names):
        if key.lower() not in {c.lower() for c in df.columns} or len(own) != len(df.columns) - 1:
            raise ValueError(f"each side needs the column {key} and distinct names, not {df.columns}")
    clash = names[0] & names[1]
    renamed = [df.withColumnsRenamed({c: c + suffix for c in df.columns if c.lower() in clash}) for df, suffix in sides]
    after = [c.lower() for df in renamed for c in df.columns if c.lower() != key.lower()]
    if twice := sorted({c for c in after if after.count(c) > 1}):
        raise ValueError(f"columns {twice} would appear twice; choose other suffixes")
    return renamed[0].join(renamed[1], key, "left")
