"""Text functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of 1024 each, in order.
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def format_size(size: Column) -> Column:
    """Bytes with one decimal in the largest unit under 1024 of it, PB at most."""
    out = F.format_string(f"%.1f {UNITS[-1]}", size / float(1024 ** (len(UNITS) - 1)))
    for k, unit in reversed(list(enumerate(UNITS[:-1]))):
        out = F.when(size < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", size / float(1024**k))).otherwise(out)
    return out
