"""Parameter counts named in model identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern. A number (digits, optionally one dot and more digits) counts
# when 'b' or 'B' follows, no ASCII letter precedes it and no word character
# follows the 'b'. The second alternative consumes every other number whole, so
# no part of a rejected one is looked at again. Possessive quantifiers keep it
# linear.
PARAM_COUNT_PATTERN = (
    r"((?<![A-Za-z])[0-9]++(?:[.][0-9]++)?+(?=[bB](?![\p{L}\p{N}_])))"
    r"|[0-9]++(?:[.][0-9]++)?+"
)

# Fixed value: above this many billion parameters a model counts as large.
LARGE_THRESHOLD_B = 10


def largest_param_count(model: Column) -> Column:
    """Largest count, in billions, named in a model identifier; NULL if none."""
    found = F.regexp_extract_all(model, F.lit(PARAM_COUNT_PATTERN), F.lit(1))
    counts = F.transform(F.filter(found, lambda s: s != ""), lambda s: s.cast("double"))
    return F.array_max(counts)


def is_large(model: Column) -> Column:
    return F.coalesce(largest_param_count(model) > LARGE_THRESHOLD_B, F.lit(False))
