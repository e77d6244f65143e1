"""Digests of content columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: bytes taken from each end of a file by a sample.
SAMPLE_END_BYTES = 64 * 1024


def full_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def sample_digest(content: Column, size: Column, end_bytes: int = SAMPLE_END_BYTES) -> Column:
    """Digest of the length and both ends; of everything when the ends meet."""
    raw = content.cast("binary")
    ends = F.concat(
        size.cast("string").cast("binary"),
        F.substring(raw, 1, end_bytes),
        F.substring(raw, -end_bytes, end_bytes),
    )
    return F.when(read_whole(size, end_bytes), F.sha2(raw, 256)).otherwise(F.sha2(ends, 256))


def read_whole(size: Column, end_bytes: int = SAMPLE_END_BYTES) -> Column:
    """A sample of a file this small has read all of it."""
    return size <= 2 * end_bytes
