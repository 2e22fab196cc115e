"""Names for helper columns that a user's table does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that ``df`` does not have yet, whatever the case."""
    have = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, n = f"_{stem}", 0
        while name.lower() in have:
            name, n = f"_{stem}{n}", n + 1
        have.add(name.lower())
        out.append(name)
    return out


def free_prefix(*frames: DataFrame) -> str:
    """A beginning that no column of the frames has, whatever the case."""
    have = [c.lower() for df in frames for c in df.columns]
    prefix, n = "_", 0
    while any(c.startswith(prefix) for c in have):
        prefix, n = f"_{n}_", n + 1
    return prefix
