"""Product quantisation of vectors by k-means with norm-of-sum bounds.

Each part of each vector keeps one lower bound on its distance to all entries but its
own, and the round in which it was made. All codebooks of earlier rounds are kept. In
a later round the bound is lowered by the largest *net* displacement of an entry since
that round, the norm of the sum of its moves, which is at most the sum of their norms
and so tighter than drifts added up round by round. Where the exact distance to the own
entry stays below the bound the assignment cannot have changed; the others are rescanned.
All distances that decide are exact integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import staged, table

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
LARGEST = 1 << 26
BATCH_ROWS = 4096
STATE = "vec_id bigint, label bigint, vector array<int>, code binary, bound binary, stamp binary, error bigint, rescans int"


def kept_vectors(rows: DataFrame, scale: int = SCALE, vector: str = "embedding") -> DataFrame:
    """``(vec_id, label, vector)`` with integer components, without the rows whose vector
    is null or holds a component that is null or not finite."""
    sound = F.col(vector).isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    )
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    kept = rows.filter(sound).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("vector"))
    fits = F.forall("vector", lambda x: (x < LARGEST) & (x > -LARGEST))
    return kept.withColumn(
        "vector",
        F.when(fits, F.col("vector").cast("array<int>")).otherwise(
            F.raise_error(F.lit(f"a component is beyond {LARGEST // scale}, where distances leave 64 bits"))
        ),
    )


def _batch(column: pa.Array, parts: int) -> np.ndarray:
    """The vectors of an Arrow column as (row, part, component) integers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return values.reshape(len(column), parts, -1)


def distances(vectors: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of each part, (row, component), to all entries of its codebook."""
    apart = vectors[:, None, :] - book[None, :, :]
    return np.einsum("ijk,ijk->ij", apart, apart)


def net_moves(history: np.ndarray) -> np.ndarray:
    """For each earlier round, part and entry: how far that entry lies from its place then,
    rounded upwards."""
    moved = (history[-1][None] - history).astype(float)
    return np.sqrt((moved * moved).sum(axis=-1)) * (1 + 1e-12) + 1e-9


def assign(vectors, code, bound, stamp, history, own_moves_out):
    """Codes, bounds, stamps, squared errors and the number of parts rescanned, by the
    last codebook of ``history``; the first three may be None.

    ``own_moves_out[t, p, e]`` is the largest net move since round ``t`` of an entry of
    part ``p`` other than ``e``.
    """
    now = len(history) - 1
    book = history[-1]
    n, parts, _ = vectors.shape
    if code is None:
        code, bound, stamp = np.zeros((n, parts), np.uint8), np.full((n, parts), -np.inf), np.full((n, parts), now, np.uint8)
    else:
        code, bound, stamp = code.copy(), bound.copy(), stamp.copy()
    error = np.zeros((n, parts), np.int64)
    rescans = np.zeros(n, np.int64)
    for p in range(parts):
        mine = vectors[:, p] - book[p][code[:, p]]
        error[:, p] = np.einsum("ij,ij->i", mine, mine)
        low = bound[:, p] - own_moves_out[stamp[:, p], p, code[:, p]]
        unsure = np.flatnonzero(np.sqrt(error[:, p].astype(float)) * (1 + 1e-12) + 1e-9 >= low)
        if not len(unsure):
            continue
        far = distances(vectors[unsure, p], book[p])
        best = far.argmin(axis=1)  # the lowest index among equal distances
        rows = np.arange(len(unsure))
        error[unsure, p], code[unsure, p] = far[rows, best], best
        far[rows, best] = np.iinfo(np.int64).max
        second = far.min(axis=1, initial=np.iinfo(np.int64).max).astype(float)
        bound[unsure, p], stamp[unsure, p] = np.sqrt(second) * (1 - 1e-12), now
        rescans[unsure] += 1
    return code, bound, stamp, error, rescans


def _others_moved(history: np.ndarray) -> np.ndarray:
    """``[t, p, e]``: the largest net move since round ``t`` of the entries other than ``e``."""
    moves = net_moves(history)
    out = np.zeros_like(moves)
    for e in range(moves.shape[2]):
        others = np.delete(moves, e, axis=2)
        out[:, :, e] = others.max(axis=2) if others.shape[2] else 0.0
    return out


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def assigned(state: DataFrame, history: np.ndarray, parts: int) -> DataFrame:
    """One round: ``state`` with codes, bounds and stamps brought up to the last codebook."""
    sent = state.sparkSession.sparkContext.broadcast((history, _others_moved(history)))  # fixed size
    fresh = "code" not in state.columns

    def run(batches):
        history, moved = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(start, BATCH_ROWS)
                if not rows.num_rows:
                    continue
                held = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(-1, parts)
                old = (None, None, None) if fresh else (held("code", np.uint8), held("bound", float), held("stamp", np.uint8))
                code, bound, stamp, error, rescans = assign(_batch(rows.column("vector"), parts), *old, history, moved)
                columns = [rows.column(n) for n in ("vec_id", "label", "vector")]
                columns += [_binary(code), _binary(bound), _binary(stamp)]
                columns += [pa.array(error.sum(axis=1)), pa.array(rescans, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STATE.split(", ")])

    return state.mapInArrow(run, STATE)


def entry_sums(state: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts assigned to each entry.

    A task adds its rows up, so it sends at most a row for each entry. Sums are carried
    in 64 bits a task, of components below 2^26, and added up as decimals."""
    parts, entries, width = shape

    def add(batches):
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(start, BATCH_ROWS)
                if not rows.num_rows:
                    continue
                code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                vectors = _batch(rows.column("vector"), parts)
                for p in range(parts):
                    np.add.at(sums, p * entries + code[:, p], vectors[:, p])
                    counts += np.bincount(p * entries + code[:, p], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(at, width)),
                pa.array(np.tile(np.arange(width), len(at))),
                pa.array(sums[at].ravel()),
                pa.array(np.repeat(counts[at], width)),
            ],
            names=["entry", "at", "total", "n"],
        )

    found = state.select("code", "vector").mapInArrow(add, "entry bigint, at bigint, total bigint, n bigint")
    wide = F.sum(F.col("total").cast("decimal(38,0)")).alias("total")
    totals, counts = np.zeros((parts * entries, width), object), np.zeros(parts * entries, object)
    for entry, at, total, n in found.groupBy("entry", "at").agg(wide, F.sum("n").alias("n")).collect():
        totals[entry, at], counts[entry] = int(total), int(n)
    return totals.reshape(shape), counts.reshape(parts, entries)


def moved_entries(book: np.ndarray, totals: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of their parts; unused ones stay."""
    out = book.copy()
    for p, e in zip(*np.nonzero(counts)):
        out[p, e] = [t // counts[p, e] for t in totals[p, e]]
    return out


def first_codebook(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The parts of the vectors of the smallest ids; equal ids go by their vectors, and a
    null id comes last. Fewer vectors give fewer entries."""
    chosen = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    width = {len(row["vector"]) for row in chosen}
    if any(w % parts or not w for w in width) or len(width) > 1:
        raise ValueError(f"vectors must have one length, a multiple of {parts}; found {sorted(width)}")
    each = max(width, default=0) // parts
    return np.array([row["vector"] for row in chosen], np.int64).reshape(len(chosen), parts, each).transpose(1, 0, 2)


def compress(
    rows: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    vector: str = "embedding",
) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Codes, the final codebooks ``[part, entry, component]`` and the rescans of each round.

    The first is ``(vec_id, label, vector, code, bound, stamp, error, rescans)``, a row
    per kept vector, repeated ids included; ``code`` holds a byte for each part. Every
    round is one pass that writes the state of all vectors and one that adds up the
    parts of each entry. Null labels are kept; an empty table gives no rows and no
    codebooks. Vectors of different lengths, or beyond 2^26 after scaling, are an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    kept = staged(kept_vectors(rows, scale, vector), "codes-vectors")
    book = first_codebook(kept, parts, entries)
    if not book.size:
        empty = kept.selectExpr("*", "cast(null as binary) code", "cast(null as binary) bound", "cast(null as binary) stamp", "0L error", "0 rescans")
        return empty, np.zeros((parts, 0, 0), np.int64), []
    width = parts * book.shape[2]
    odd = kept.filter(F.size("vector") != width).select(F.size("vector")).first()
    if odd:
        raise ValueError(f"vectors must have one length; found {width} and {odd[0]}")
    state, history, scans = kept, [book], []
    for r in range(rounds + 1):
        state = staged(assigned(state, np.stack(history), parts), "codes-state")
        scans.append(int(state.agg(F.sum("rescans")).first()[0]))
        if r < rounds:
            history.append(moved_entries(history[-1], *entry_sums(state, book.shape)))
    return state, history[-1], scans


def codebook_digest(book: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``, the errors of all rows of a label added up; null
    labels are one. The sums are written before the join, so a label of many rows is
    split by Spark where it does not broadcast the sums."""
    sums = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = staged(sums, "codes-labels")
    return codes.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, book, _ = compress(table(spark, sf_dir, "embeddings"))
    out = with_label_error(codes.select("vec_id", "label", "code", "error"))
    return out.select(
        "vec_id",
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(codebook_digest(book)).alias("codebooks_sha256"),
    )


def _rounds_sql() -> str:
    """The rounds as common table expressions, one pair for each."""
    out = []
    for r in range(ROUNDS + 1):
        out.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, struct_pack(far := far, entry := entry)) AS entry, min(far) AS far FROM (
    SELECT v.vec_id, v.part, c.entry, CAST(list_sum(list_transform(range(1, len(v.v) + 1), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))) AS BIGINT) AS far
    FROM parts v JOIN book{r} c USING (part)) GROUP BY vec_id, part)""")
        if r < ROUNDS:
            out.append(f"""
book{r + 1} AS MATERIALIZED (
  SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM book{r} c LEFT JOIN (
    SELECT part, entry, list(x ORDER BY place) AS v FROM (
      SELECT part, entry, place, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (
        SELECT n.part, n.entry, unnest(range(1, len(p.v) + 1)) AS place, unnest(p.v) AS x
        FROM near{r} n JOIN parts p USING (vec_id, part))
      GROUP BY part, entry, place) GROUP BY part, entry) m USING (part, entry))""")
    return ",".join(out)


OP12_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v
  FROM kept, range({PARTS}) AS r(part)),
book0 AS MATERIALIZED (
  SELECT part, entry, v FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{_rounds_sql()},
codes AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{ROUNDS}) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""
