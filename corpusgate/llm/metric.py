"""Exact Jaccard join of documents as points of a metric space.

One minus the Jaccard similarity of two shingle sets is a metric, and so is the number of
shingles in which they differ, which is the sum of that number over the parts of any
division of all shingles. Two kinds of pivots cut the space into Voronoi regions.

*Projections* are the pivots of the first cut. Unrelated documents are all at distance
one from each other and from any document, so no document can tell them apart; in
one part of the shingles, though, the set nearest to a document is what it holds of
that part, and its region are the documents that hold the same. Two documents within
the radius differ in at most ``d`` shingles; of ``d + 1`` parts at least one is alike. So each
document is copied into the region of its projection in every part, and pairs meet there.

Regions that are too full are joined recursively: *documents* of them become pivots, every
document near a pivot falls to the nearest one, the triangle inequality says which others can
reach across the border and are copied there, and what is left is cut anew. Inside the
region of a document, sets are compared by their differences from the pivot, since the
symmetric difference of two sets is that of their differences.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import lists, map_texts, numbered, scrambled, slices, staged, stored_row, table, text_bytes
from corpusgate.llm.components import components
from corpusgate.llm.simhash import Forest

SHINGLE_WORDS = 3
PERCENT = 90
FULL = 16
PIVOTS = 1024
PIVOT_SHINGLES = 1 << 20
CAPTURE = 4.0
TILE = 1024
CLASS_RATIO = 1.5
FILTER_BITS = 1 << 26
PARITY_BITS = 1024
CHUNK_BYTES = 1 << 20
SETS_AT_ONCE = 256
HITS_AT_ONCE = 1 << 20
SLACK = 1e-9
_EVENS = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes of their words' hashes."""
    data, bounds = text_bytes(column)
    raw = data.tobytes().lower()  # ASCII letters only
    words = [raw[s:e].split() for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    counts = [len(w) for w in words]
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w) for of in words for w in of), np.uint64, sum(counts))
    whole = hashes * np.uint64(0)
    for k in range(size):
        shifted = hashes[k:]
        whole = scrambled(whole[: len(shifted)] + shifted)
    out, at = [], 0
    for n in counts:
        if 0 < n < size:
            one = np.zeros(1, np.uint64)
            for h in hashes[at : at + n]:
                one = scrambled(one + h)
            out.append(one)
        else:
            out.append(np.unique(whole[at : at + max(n - size + 1, 0)]))
        at += n
    return out


def _read(docs: DataFrame, rid: Column, size: int) -> DataFrame:
    """``(rid, doc_id, key, n)``: a row per document with a 128-bit ``key`` of its set."""

    def work(rows: pa.RecordBatch, _):
        sets = shingle_sets(rows.column(2), size)
        return rows.column(0), rows.column(1), [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [len(s) for s in sets]

    return map_texts(numbered(docs, rid), "rid string, doc_id bigint, key binary, n bigint", work, chunk_bytes=CHUNK_BYTES)


class Projections:
    """Divisions of all shingles into parts, one for each class of set sizes.

    A class covers sizes up to ``CLASS_RATIO`` times its smallest. Sets meet in the class
    of the larger one, so a set also takes part in the next class if its partner can be
    there. Two linked sets whose larger one is in a class differ in at most ``d`` shingles,
    so of ``d + spare + 1`` parts more than ``spare`` are alike. An empty part is no pivot, as
    many sets share it; a set with more than ``spare`` empty ones also stands in a region of
    such sets.
    """

    def __init__(self, percent: int):
        self.percent, self.classes = percent, [1]

    def divisions(self, n: int) -> list[tuple[int, int, int]]:
        """``(class, parts, spare)`` of the divisions that a set of ``n`` shingles takes part in."""
        while len(self.classes) < 3 or self.classes[-2] <= 100 * n // max(self.percent, 1) + 1:
            self.classes.append(max(int(self.classes[-1] * CLASS_RATIO), self.classes[-1] + 1))
        home = int(np.searchsorted(self.classes, n, side="right")) - 1
        out = []
        for number in range(home, len(self.classes) - 1):
            if number > home and 100 * n < self.percent * self.classes[number]:
                break
            largest = self.classes[number + 1] - 1
            apart = 2 * largest * (100 - self.percent) // (100 + self.percent)
            if apart:  # else only equal sets are linked
                spare = 2 + apart // 50
                out.append((number, apart + spare + 1, spare))
        return out

    def regions(self, s: np.ndarray) -> np.ndarray:
        """The regions of a set, as hashes of a division, a part and what the set holds of it."""
        out = [np.zeros(0, np.uint64)]
        for number, parts, spare in self.divisions(len(s)) if len(s) else ():
            part = ((s >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
            held = np.zeros(parts, np.uint64)
            np.add.at(held, part, scrambled(s ^ np.uint64(number + 1)))
            full = np.flatnonzero(np.bincount(part, minlength=parts))
            place = (np.uint64(number) << np.uint64(32)) + full.astype(np.uint64)
            out.append(scrambled(held[full] + scrambled(place)))
            if parts - len(full) > spare:
                out.append(scrambled(np.array([number], np.uint64) + _EVENS))
        return np.concatenate(out)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """The parity of each set's shingles in ``PARITY_BITS`` classes, as rows of 64-bit
    words. Two sets differ in at least as many shingles as their parities do."""
    out = np.zeros((len(sets), PARITY_BITS), np.uint8)
    for i, s in enumerate(sets):
        at = (s * _EVENS >> np.uint64(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
        out[i] = np.bincount(at, minlength=PARITY_BITS) & 1
    return np.packbits(out, axis=1).view(np.int64).reshape(len(sets), PARITY_BITS // 64)


def _profiles(docs: DataFrame, rid: Column, size: int, percent: int) -> DataFrame:
    """``(rid, pivots, parity)``: the regions of each document's set, and its parities."""

    def work(rows: pa.RecordBatch, projections):
        sets = shingle_sets(rows.column(2), size)
        regions = _arrays([projections.regions(s) for s in sets])
        return rows.column(0), regions, lists(np.full(len(sets), PARITY_BITS // 64), parities(sets).ravel(), pa.int64())

    schema = "rid string, pivots array<bigint>, parity array<bigint>"
    return map_texts(numbered(docs, rid), schema, work, lambda: Projections(percent), chunk_bytes=CHUNK_BYTES)


def _arrays(sets: list[np.ndarray]) -> pa.ListArray:
    values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
    return lists(np.array([len(s) for s in sets], np.int64), values, pa.int64())


def _unpacked(column: pa.Array) -> list[np.ndarray]:
    """The sets of an Arrow column of lists."""
    values = column.flatten().to_numpy().view(np.uint64)
    ends = np.cumsum([0, *(len(x) for x in column)])
    return [values[s:e] for s, e in zip(ends[:-1], ends[1:])]


def _bit_filter(keys: DataFrame, key: Column):
    """A broadcast of ``FILTER_BITS`` bits, those of the keys' hashes set."""
    marked = keys.select(F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)).alias("bit")).groupBy(F.expr("bit div 64").alias("word"))
    found = marked.agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits")).toArrow()  # at most one row per 64 bits
    cells = np.zeros(FILTER_BITS // 64, np.int64)
    cells[found["word"].to_numpy()] = found["bits"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(cells)


def _passing(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)


def _region_rows(profiles: DataFrame) -> DataFrame:
    """``(s, node, n)``: a row for each region ``s`` of a node in which others stand too."""
    own = profiles.select(F.explode("pivots").alias("s"))
    shared = staged(own.groupBy("s").agg(F.count("*").alias("c")).filter("c > 1").select("s"), "metric-shared")
    sent = _bit_filter(shared, F.col("s"))
    rows = profiles.select("node", "n", F.explode("pivots").alias("s"))
    rows = rows.withColumn("bit", F.pmod(F.xxhash64("s"), F.lit(FILTER_BITS)))

    def run(batches):
        for batch in batches:
            live = _passing(sent.value, batch.column(3).to_numpy())
            yield batch.take(pa.array(live)).select(["s", "node", "n"])

    return staged(rows.mapInArrow(run, "s bigint, node bigint, n bigint"), "metric-regions")


def _sets_of(docs: DataFrame, rid: Column, wanted: DataFrame, size: int) -> DataFrame:
    """``wanted`` rows, which have a ``rid``, with their ``set``; a filter of fixed size
    keeps most other documents from being cut up and from leaving their task."""
    sent = _bit_filter(wanted, F.col("rid"))

    def run(batches):
        for batch in batches:
            chosen = batch.take(pa.array(_passing(sent.value, batch.column(3).to_numpy())))
            lengths = np.diff(text_bytes(chosen.column(2))[1])
            for rows in slices(chosen, lengths, CHUNK_BYTES):
                sets = _arrays(shingle_sets(rows.column(2), size))
                yield pa.RecordBatch.from_arrays([rows.column(0), sets], names=["rid", "set"])

    made = numbered(docs, rid).withColumn("bit", F.pmod(F.xxhash64("rid"), F.lit(FILTER_BITS)))
    return made.mapInArrow(run, "rid string, set array<bigint>").join(wanted, "rid").drop("rid")


class PivotIndex:
    """The sets of a bounded number of pivots by shingle."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(values, kind="stable")
        self.owner = owner[order]
        self.values, self.first, self.many = np.unique(values[order], return_index=True, return_counts=True)

    def near(self, sets: list[np.ndarray], reach: float):
        """Set number, pivot, and number of shingles in which they differ, of all pairs
        within the distance ``reach``, which is below one."""
        parts = [self._near(sets[at : at + SETS_AT_ONCE], at, reach) for at in range(0, max(len(sets), 1), SETS_AT_ONCE)]
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _near(self, sets, first, reach):
        k = len(self.sets)
        sizes = np.array([len(s) for s in sets], np.int64)
        of = np.repeat(np.arange(len(sets)), sizes)
        all_ = np.concatenate([*sets, np.zeros(0, np.uint64)])
        at = np.minimum(np.searchsorted(self.values, all_), len(self.values) - 1)
        held = np.flatnonzero(self.values[at] == all_) if len(all_) else np.zeros(0, np.int64)
        of, at = of[held], at[held]
        ends = np.cumsum(self.many[at])  # a common shingle belongs to many pivots
        common = np.zeros(len(sets) * k, np.int64)
        start = 0
        while start < len(of):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + HITS_AT_ONCE, side="right")))
            many = self.many[at[start:stop]]
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pivot = self.owner[np.repeat(self.first[at[start:stop]], many) + step]
            common += np.bincount(np.repeat(of[start:stop], many) * k + pivot, minlength=len(common))
            start = stop
        pairs = np.flatnonzero(common)
        of, pivot = pairs // k, pairs % k
        apart = sizes[of] + self.sizes[pivot] - 2 * common[pairs]
        close = apart <= (reach + SLACK) * (sizes[of] + self.sizes[pivot] - common[pairs])
        return of[close] + first, pivot[close], apart[close]


def _chosen(candidates: list[tuple[int, np.ndarray]], capture: float) -> list[tuple[int, np.ndarray]]:
    """Candidates, in their order, that no pivot chosen before captures."""
    index = PivotIndex([s for _, s in candidates])
    a, b, _ = index.near(index.sets, capture)
    near = {}
    for x, y in zip(a.tolist(), b.tolist()):
        near.setdefault(x, []).append(y)
    taken, out = set(), []
    for i, candidate in enumerate(candidates):
        if taken.isdisjoint(near.get(i, ())):
            taken.add(i)
            out.append(candidate)
    return out


def _distances(sets: DataFrame, index, reach: float) -> DataFrame:
    """``(node, n, docs, crowded, pivot, apart, far, ring, diff)`` of the nodes within
    ``reach`` of pivots: in how many shingles they differ, the distance, and those shingles."""

    def run(batches):
        pivots, radius = PivotIndex(index.value[0]), index.value[1]
        for batch in batches:
            for rows in slices(batch, 8 * batch.column(1).to_numpy(), CHUNK_BYTES):
                held = _unpacked(rows.column(4))
                of, pivot, apart = pivots.near(held, reach)
                sizes = np.array([len(s) for s in held], np.int64)
                twice = sizes[of] + pivots.sizes[pivot] + apart  # of the size of the union
                diffs = [np.setxor1d(held[i], pivots.sets[j], assume_unique=True).tobytes() for i, j in zip(of, pivot)]
                columns = [c.take(pa.array(of)) for c in rows.columns[:4]]
                columns += [pa.array(pivot.astype(np.int32)), pa.array(apart), pa.array(2 * apart / twice)]
                columns += [pa.array((200 * apart // (twice * radius)).astype(np.int32)), pa.array(diffs, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "node bigint, n bigint, docs bigint, crowded boolean, pivot int, apart bigint, far double, ring int, diff binary"
    names = [c.split()[0] for c in schema.split(", ")]
    return sets.select("node", "n", "docs", "crowded", "set").mapInArrow(run, schema)


def compared(left: pd.DataFrame, right: pd.DataFrame, percent: int) -> np.ndarray:
    """Which pairs of two tiles of a region are linked, as a matrix.

    Two sets differ in the sum of their numbers of differences from the pivot, less
    twice those they have in common. Only where that sum alone is too large are common
    differences counted, by products of tiles of the incidence matrices.
    """
    size = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :]
    apart = left["apart"].to_numpy()[:, None] + right["apart"].to_numpy()[None, :]
    allowed = size * (100 - percent)
    if (apart * (100 + percent) <= allowed).all():
        return np.ones(size.shape, bool)
    a, b = ([np.frombuffer(d, np.uint64) for d in side["diff"]] for side in (left, right))
    (fa, va), (fb, vb) = ((np.repeat(np.arange(len(x)), [len(s) for s in x]), np.concatenate([*x, np.zeros(0, np.uint64)])) for x in (a, b))
    both = np.intersect1d(va, vb)
    common = np.zeros(size.shape, np.float32)
    for start in range(0, len(both), TILE):
        part = both[start : start + TILE]
        sides = []
        for f, v, n in ((fa, va, len(a)), (fb, vb, len(b))):
            at = np.minimum(np.searchsorted(part, v), len(part) - 1)
            held = part[at] == v
            dense = np.zeros((n, len(part)), np.float32)
            dense[f[held], at[held]] = 1
            sides.append(dense)
        common += sides[0] @ sides[1].T
    return (apart - 2 * common.astype(np.int64)) * (100 + percent) <= allowed


def _masked(values: np.ndarray, null: np.ndarray) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(values.astype(np.int64), null)


def _region_links(rows: DataFrame, percent: int, tile: int) -> DataFrame:
    """``(a, b, partners)`` from the regions of document pivots: forests as pairs ``a, b``,
    and for each node ``a`` how many documents of other nodes it is linked to, ``b`` being null.

    ``rows`` are ``(pivot, member, node, docs, n, apart, ring, diff)``. Rings are as wide as
    the radius, so only neighbouring ones meet. Rings are dealt into tiles, and a pair of
    tiles is one group, of at most about two tiles, whatever the size of its region.
    """
    count = rows.groupBy("pivot", "ring").agg(F.count("*").alias("c"))
    parts = count.select("pivot", "ring", F.expr(f"cast((c + {tile - 1}) div {tile} as int)").alias("parts"))
    tiles = parts.select("pivot", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = tiles.select("pivot", F.col("ring").alias("ring2"), F.col("part").alias("part2"))
    meet = F.expr("ring2 - ring = 1 OR (ring2 = ring AND part2 >= part)")
    pairs = tiles.join(other, "pivot").filter(meet).withColumn("pair", F.monotonically_increasing_id())
    pairs = staged(pairs, "metric-tiles")
    dealt = rows.join(parts, ["pivot", "ring"]).withColumn("part", F.expr("cast(pmod(xxhash64(node), parts) as int)"))
    twin = F.expr("ring = ring2 AND part = part2").alias("twin")
    columns = ["member", "node", "docs", "n", "apart", "diff"]
    left = dealt.join(pairs.select("pivot", "ring", "part", "pair", twin), ["pivot", "ring", "part"])
    right = pairs.filter("NOT (ring = ring2 AND part = part2)").select(
        "pivot", F.col("ring2").alias("ring"), F.col("part2").alias("part"), "pair", F.lit(False).alias("twin")
    )
    right = dealt.join(right, ["pivot", "ring", "part"])
    sides = left.select("pair", "twin", F.lit(0).alias("side"), *columns).union(
        right.select("pair", "twin", F.lit(1).alias("side"), *columns)
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        twin = bool(group["twin"].iloc[0])
        a = group[group["side"] == 0]
        b = a if twin else group[group["side"] == 1]
        if not len(a) or not len(b):
            none = np.zeros(0, np.int64)
            return pd.DataFrame({"a": none, "b": none, "partners": none})
        links = compared(a, b, percent)
        links &= a["member"].to_numpy()[:, None] | b["member"].to_numpy()[None, :]
        if twin:
            np.fill_diagonal(links, False)
        x, y = np.nonzero(links)
        nodes = np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()])
        forest = Forest(len(nodes))
        if twin:
            forest.join(np.arange(len(a)), np.arange(len(a)) + len(a))
        forest.join(x, y + len(a))
        roots = forest.roots(np.arange(len(nodes)))
        moved = np.flatnonzero(nodes != nodes[roots])
        partners = [(a, links @ b["docs"].to_numpy())] + ([] if twin else [(b, links.T @ a["docs"].to_numpy())])
        ends = np.concatenate([nodes[moved], *(side["node"].to_numpy()[p > 0] for side, p in partners)])
        many = np.concatenate([nodes[roots[moved]], *(p[p > 0] for _, p in partners)])
        pair = np.arange(len(ends)) < len(moved)
        return pd.DataFrame({"a": ends, "b": _masked(many, ~pair), "partners": _masked(many, pair)})

    return sides.groupBy("pair").applyInPandas(compare, "a bigint, b bigint, partners bigint")


def _likely(rows: DataFrame, profiles: DataFrame, percent: int, name: str) -> DataFrame:
    """``(a, b, total)``: pairs of nodes that share a region and may be linked: neither
    their sizes nor their parities tell that they are not."""
    other = rows.select("s", F.col("node").alias("b"), F.col("n").alias("n2"))
    total = F.col("n") + F.col("n2")
    possible = (F.col("node") < F.col("b")) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    pairs = rows.join(other, "s").filter(possible).select(F.col("node").alias("a"), "b", total.alias("total"))
    pairs = staged(pairs.distinct(), f"{name}-possible")
    parity = profiles.select("node", "parity")
    for end in "ab":
        pairs = pairs.join(parity.select(F.col("node").alias(end), F.col("parity").alias(f"parity_{end}")), end)
    differ = F.expr("aggregate(zip_with(parity_a, parity_b, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
    likely = pairs.filter(differ * (100 + percent) <= (100 - percent) * F.col("total"))
    return staged(likely.select("a", "b", "total"), f"{name}-likely")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b)`` of the ``pairs`` that are linked, compared shingle by shingle."""
    for end in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(end), F.col("set").alias(f"set_{end}")), end)
    common = F.size(F.array_intersect("set_a", "set_b")).cast("bigint")
    return pairs.filter(common * (100 + percent) >= percent * F.col("total")).select("a", "b")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b"))


def _pivots(crowded: DataFrame, sets: DataFrame, pivots: int, capture: float) -> list[tuple[int, np.ndarray]]:
    """Documents of the fullest regions, one of each, no two near each other; together
    about ``PIVOT_SHINGLES`` shingles."""
    best = crowded.groupBy(F.col("pivot.node").alias("node")).agg(F.max("c").alias("c"))
    best = best.join(sets.select("node", "n"), "node").orderBy(F.desc("c"), "node").limit(pivots)
    nodes, total = [], 0
    for row in best.collect():  # at most ``pivots`` rows
        total += row["n"]
        if nodes and total > PIVOT_SHINGLES:
            break
        nodes.append(row["node"])
    if not nodes:
        return []
    wanted = sets.sparkSession.createDataFrame([(n,) for n in nodes], "node bigint")
    found = sets.select("node", "set").join(F.broadcast(wanted), "node").toArrow()
    held = dict(zip(found["node"].to_pylist(), _unpacked(found["set"].combine_chunks())))
    return _chosen([(node, held[node]) for node in nodes], capture)


def links(docs: DataFrame, rid: Column, profiles: DataFrame, percent: int, size: int, full: int, pivots: int, tile: int):
    """``(a, b, partners)`` as of ``_region_links``, over all regions of all rounds.

    Pairs of small regions are listed. Nodes of regions with more than ``full`` are
    captured by document pivots, in rounds, and compared in their regions, also with
    the nodes that they may be linked to in small ones. Pairs with a captured node are
    settled there; the listed ones that are left, and those that still meet in a full
    region when pivots capture nothing more, are compared one by one.
    """
    radius = (100 - percent) / 100
    capture = min(CAPTURE * radius, 0.9 - radius)
    rows = _region_rows(profiles)
    counts = rows.groupBy("s").agg(F.count("*").alias("c"))
    crowded = staged(counts.filter(F.col("c") > full).select("s"), "metric-crowded")
    pairs = _likely(rows.join(crowded, "s", "left_anti"), profiles, percent, "metric-small")
    rows = staged(rows.join(crowded, "s", "left_semi"), "metric-full")
    dense = staged(rows.select("node").distinct().withColumn("crowded", F.lit(True)), "metric-dense")
    needed = _ends(pairs).union(dense.select("node")).distinct().join(dense, "node", "left")
    needed = needed.join(profiles.select("node", "rid", "n", "docs"), "node")
    needed = staged(needed.withColumn("crowded", F.coalesce("crowded", F.lit(False))), "metric-needed")
    sets = staged(_sets_of(docs, rid, needed, size), "metric-sets")
    first = F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("pivot")
    found, outer = [], sets
    while 0 < radius < 0.45:
        regions = rows.groupBy("s").agg(F.count("*").alias("c"), first).filter(F.col("c") > full)
        chosen = _pivots(regions, outer, pivots, capture)
        if not chosen:
            break
        index = docs.sparkSession.sparkContext.broadcast(([s for _, s in chosen], 100 - percent))
        near = staged(_distances(outer, index, capture + radius), "metric-near")
        mine = near.filter((F.col("far") <= capture) & F.col("crowded"))
        mine = staged(mine.groupBy("node").agg(F.min(F.struct("far", "pivot")).alias("own")), "metric-own")
        member = F.col("own.pivot").eqNullSafe(F.col("pivot"))
        border = F.col("own").isNull() | ((F.col("pivot") < F.col("own.pivot")) & (F.col("far") <= F.col("own.far") + 2 * radius + SLACK))
        near = near.join(mine, "node", "left").withColumn("member", member).filter(F.col("member") | border)
        near = staged(near.select("pivot", "member", "node", "docs", "n", "apart", "ring", "diff"), "metric-members")
        found.append(staged(_region_links(near, percent, tile), "metric-region-links"))
        rows = staged(rows.join(mine, "node", "left_anti"), "metric-full")
        outer = outer.join(mine, "node", "left_anti")
        for end in "ab":
            pairs = pairs.join(mine.select(F.col("node").alias(end)), end, "left_anti")
        if 2 * mine.count() < full * len(chosen):  # pivots no longer empty a region
            break
    pairs = pairs.union(_likely(rows, profiles, percent, "metric-full").select(pairs.columns)).distinct()
    leaf = staged(_verified(pairs, sets, percent), "metric-links")
    weight = profiles.select(F.col("node").alias("b"), "docs")
    degrees = leaf.union(leaf.select("b", "a")).join(weight, "b").groupBy("a").agg(F.sum("docs").alias("partners"))
    none = F.lit(None).cast("bigint")
    out = leaf.select("a", "b", none.alias("partners")).union(degrees.select("a", none.alias("b"), "partners"))
    for part in found:
        out = out.union(part.select("a", "b", "partners"))
    return out


def jaccard_classes(
    docs: DataFrame,
    percent: int = PERCENT,
    size: int = SHINGLE_WORDS,
    rid: Column | None = None,
    full: int = FULL,
    pivots: int = PIVOTS,
    tile: int = TILE,
) -> DataFrame:
    """``(rid, doc_id, n_shingles, component_id, n_links)``, a row per document.

    Documents whose sets of distinct ``size``-word shingles have a Jaccard similarity of
    at least ``percent`` in a hundred are linked; ``component_id`` is the smallest
    ``doc_id`` reachable, ``n_links`` how many other documents a document is linked to.
    Shingles are compared by 64-bit hashes of their words. Equal sets are one node.
    Texts of fewer words are one shingle. Null texts and those without words have an
    empty set, no links, and their own id as ``component_id``. Repeated rows are
    documents of their own; a null id counts only where its component has no other.
    An empty table gives an empty result. ``full`` and ``pivots`` say from how many
    documents on a region is cut again, and into how many at a time, ``tile`` how many
    documents of a region a task holds twice; they only change the work.
    """
    if rid is None:
        docs = staged(numbered(docs), "metric-docs")
        rid = F.col("rid")
    read = staged(_read(docs, rid, size), "metric-read")
    equal = read.filter("n > 0").groupBy("key").agg(
        F.min("rid").alias("rid"), F.min("doc_id").alias("least"), F.count("*").alias("docs"), F.max("n").alias("n")
    )
    nodes = staged(equal.withColumn("node", F.monotonically_increasing_id()), "metric-nodes")
    profiles = _profiles(docs, rid, size, percent).join(nodes.select("rid", "node", "n", "docs"), "rid")
    profiles = staged(profiles, "metric-profiles")
    found = staged(links(docs, rid, profiles, percent, size, full, pivots, tile), "metric-found")
    roots = staged(components(found.filter("b IS NOT NULL").select("a", "b"), "metric-components"), "metric-roots")
    partners = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("partners").alias("partners"))
    nodes = nodes.join(partners, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = staged(
        nodes.join(least, "root").select("key", "component_id", (F.coalesce("partners", F.lit(0)) + F.col("docs") - 1).alias("n_links")),
        "metric-named",
    )
    out = read.join(named, "key", "left")
    empty = F.col("n") == 0
    return out.select(
        "rid",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(empty, F.lit(0).cast("bigint")).otherwise(F.col("n_links")).alias("n_links"),
    )


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"), rid=stored_row()).drop("rid")


OP11_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SHINGLE_WORDS} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {SHINGLE_WORDS - 2}), lambda i: array_to_string(w[i:i + {SHINGLE_WORDS - 1}], ' '))) END AS s
  FROM words),
one AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM one a JOIN one b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * c >= {PERCENT} * (len(x.s) + len(y.s) - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, coalesce(n, 0) AS n_links
FROM sets JOIN least USING (doc_id) LEFT JOIN degree USING (doc_id)
"""
