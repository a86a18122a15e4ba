"""Incremental forms of the scorer and of the level counts."""

from snaplevel.streaming.incremental import (
    level_counts_stream,
    read_level_counts,
    read_stream,
    run_level_counts,
    run_scoring,
    score_stream,
)

__all__ = [
    "level_counts_stream",
    "read_level_counts",
    "read_stream",
    "run_level_counts",
    "run_scoring",
    "score_stream",
]
