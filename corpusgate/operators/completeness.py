"""Required and optional members per group.

One boolean aggregate per catalogue entry: the buffers have a fixed size and
merge before the shuffle, however many rows a group has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Files of an exported adapter, in catalogue order.
ADAPTER_REQUIRED = ["adapter_config.json", "adapter_model.safetensors"]
ADAPTER_OPTIONAL = [
    "tokenizer.json",
    "tokenizer_config.json",
    "special_tokens_map.json",
    "vocab.json",
    "merges.txt",
    "tokenizer.model",
]


def members(
    df: DataFrame, key: list[str], member: str, required: list[str], optional: list[str]
) -> DataFrame:
    """``(key…, missing, present)``: required ones absent, known ones present.

    Both arrays follow catalogue order, required before optional.
    """
    catalogue = required + optional
    flags = df.groupBy(*key).agg(
        *[
            F.coalesce(F.bool_or(F.col(member) == name), F.lit(False)).alias(f"m{i}")
            for i, name in enumerate(catalogue)
        ]
    )

    def pick(names: list[str], present: bool):
        picked = [
            F.when(F.col(f"m{catalogue.index(n)}") == present, F.lit(n)) for n in names
        ]
        return F.array_compact(F.array(*picked))

    return flags.select(
        *key, pick(required, False).alias("missing"), pick(catalogue, True).alias("present")
    )
