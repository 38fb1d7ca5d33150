"""Evaluation inputs that occur in training text, and training text that does not.

Rows are compared by the digest of their normalised text. Before a large side is
shuffled it passes a Bloom filter of the small side's digests: one 64-bit cell a key,
built by a mergeable aggregate of at most ``MAX_CELLS`` rows, so what is broadcast is
bounded however large either side is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgate.functions.text import UNICODE_WHITESPACE, is_blank, strip
from corpusgate.session import staged

# Cells of 64 bits; two columns of 8 bytes each, so at most 16 MiB are broadcast.
MAX_CELLS = 1 << 20
KEYS_PER_CELL = 4
BITS_PER_KEY = 4
# Digests that are broadcast as they are, about 16 MiB.
MAX_BROADCAST = 1 << 17

# The ranges in front hold no white space; most characters leave the test there.
_SPACES = r"[[^!-~\u00a1-\u167f\u3001-\x{10ffff}]&&[" + "".join(f"\\u{ord(c):04x}" for c in UNICODE_WHITESPACE) + "]]+"


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.lower(F.regexp_replace(strip(text), _SPACES, " "))


def input_digest(text: Column) -> Column:
    """SHA-256 of the normalised text; null for a null or blank one, which matches nothing."""
    return F.when(~is_blank(text), F.sha2(normalised(text), 256))


def _cell(key: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(cells))


def _mask(key: Column) -> Column:
    """The bits of a key in its cell, taken from a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    bits = None
    for i in range(BITS_PER_KEY):
        place = F.shiftrightunsigned(second, 6 * i).bitwiseAND(63).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return bits


def bloom_cells(n_keys: int) -> int:
    """Cells for about ``n_keys`` keys, a power of two; 0 where even ``MAX_CELLS`` would be too full to filter."""
    cells = 1024
    while cells * KEYS_PER_CELL < n_keys:
        cells *= 2
    return cells if cells <= MAX_CELLS else 0


def bloom_filter(keys: DataFrame, key: str, cells: int) -> DataFrame:
    """``(cell, bits)``: at most ``cells`` rows, whatever the number of keys."""
    column = F.col(key)
    return keys.filter(column.isNotNull()).groupBy(_cell(column, cells).alias("cell")).agg(F.bit_or(_mask(column)).alias("bits"))


def maybe_in(rows: DataFrame, key: str, bloom: DataFrame, cells: int, flag: str) -> DataFrame:
    """``rows`` with ``flag``: false only where the key is surely not in the filter."""
    hidden = [f"{flag}_cell", f"{flag}_bits"]
    held = F.broadcast(bloom.select(F.col("cell").alias(hidden[0]), F.col("bits").alias(hidden[1])))
    joined = rows.join(held, _cell(F.col(key), cells) == F.col(hidden[0]), "left")
    mask = _mask(F.col(key))
    inside = F.col(key).isNotNull() & (F.col(hidden[1]).bitwiseAND(mask) == mask)
    return joined.withColumn(flag, F.coalesce(inside, F.lit(False))).drop(*hidden)


def _keyed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the digest, generated from a one-element array: Catalyst would
    otherwise copy the whole expression into each filter and join on it."""
    return rows.withColumn(name, F.explode(F.array(input_digest(F.col(text)))))


def _free_name(*sides: DataFrame) -> str:
    taken = {c.lower() for side in sides for c in side.columns}
    name = "overlap_key"
    while any(t.startswith(name) for t in taken):
        name += "_"
    return name


def shared_inputs(suite: DataFrame, training: DataFrame, suite_text: str = "input", training_text: str = "content") -> DataFrame:
    """The rows of ``suite`` whose text also stands in ``training``; a left semi join.

    Training rows that the filter of the suite's digests rules out never leave their
    task, and of the others each digest is sent once a task. Without a filter, for a
    suite of more than four million texts, all digests are.
    """
    key = _free_name(suite, training)
    asked = staged(_keyed(suite, suite_text, key), "overlap-suite")
    said = _keyed(training, training_text, key).select(key).filter(F.col(key).isNotNull())
    cells = bloom_cells(asked.agg(F.approx_count_distinct(key)).first()[0])
    if cells:
        flag = f"{key}_maybe"
        said = maybe_in(said, key, staged(bloom_filter(asked, key, cells), "overlap-bloom"), cells, flag).filter(flag).select(key)
    return asked.join(staged(said.distinct(), "overlap-said"), key, "left_semi").select(*suite.columns)


def without_shared(training: DataFrame, suite: DataFrame, training_text: str = "content", suite_text: str = "input") -> DataFrame:
    """The rows of ``training`` whose text is no input of ``suite``; a left anti join.

    Up to ``MAX_BROADCAST`` distinct digests of a suite are broadcast, and the rows are
    read once and not shuffled. Beyond, rows that the filter rules out stay without a
    shuffle; only the others are joined, with the suite's digests, which are written
    before, so that a text that very many rows share is split. Null and blank texts stay.
    """
    key = _free_name(suite, training)
    asked = staged(_keyed(suite, suite_text, key).select(key).filter(F.col(key).isNotNull()).distinct(), "overlap-asked")
    rows = _keyed(training, training_text, key)
    n_asked = asked.count()
    if n_asked <= MAX_BROADCAST:
        return rows.join(F.broadcast(asked), key, "left_anti").select(*training.columns)
    cells = bloom_cells(n_asked)
    if not cells:
        return rows.join(asked, key, "left_anti").select(*training.columns)
    flag = f"{key}_maybe"
    rows = maybe_in(rows, key, staged(bloom_filter(asked, key, cells), "overlap-bloom"), cells, flag)
    doubtful = rows.filter(flag).join(asked, key, "left_anti")
    return rows.filter(~F.col(flag)).select(*training.columns).unionByName(doubtful.select(*training.columns))
