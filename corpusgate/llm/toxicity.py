"""Toxicity by a support vector machine over a gap-weighted subsequence kernel."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgate.llm.common import (
    CHUNK_BYTES,
    held_out,
    map_texts,
    numbered,
    slices,
    staged,
    table,
    text_bytes,
    word_spans,
)

SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 6000
VOCABULARY = 20_000
SUSPECTS = 400
LANDMARKS = 500
LOWEST = -4.0
DECAY = 0.8
COST = 1.0
ROUNDS = 4
SURE = 5
OFTEN = 0.1
BENT_COST, BENT_MARGIN = 5.0, 2.0
BENT_SIGNS = "xq1*e"
SYMBOLS = 64
SLOTS = 1 << 20
REACH = 5
# The other places of a subsequence of four, counted from its first.
STEPS = [(i, j, k) for k in range(3, REACH + 1) for j in range(2, k) for i in range(1, j)]


def _symbols() -> np.ndarray:
    """Each byte's symbol: 0 ends a word, letters are case-folded, bytes of other
    scripts keep five bits."""
    kind = np.full(256, 28, np.int64)
    kind[list(b" \t\n\r\v\f")] = 0
    for i in range(26):
        kind[97 + i] = kind[65 + i] = i + 1
    kind[48:58] = 27
    kind[128:] = 29 + np.arange(128) % 32
    return kind


_LETTER = (_symbols() > 0) & (_symbols() < 27)
_SIGN = (_symbols() == 27) | (_symbols() == 28)


def _without(data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without the spans, and their new bounds."""
    change = np.zeros(len(data) + 1, np.int64)
    change[starts] += 1
    change[ends] -= 1
    keep = np.cumsum(change)[:-1] == 0
    return data[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _joined(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts without what is put between letters to hide a word: up to three signs or
    digits between two letters, as in ``i.d.i.o.t`` or ``id1iot``, and then the blanks in
    runs of three or more single letters, as in ``i d i o t``."""
    letter, sign = _LETTER[data], _SIGN[data]
    starts, ends, text = word_spans(sign, bounds)
    inner = (ends - starts <= 3) & (starts > bounds[text]) & (ends < bounds[text + 1])
    starts, ends = starts[inner], ends[inner]
    inner = letter[starts - 1] & letter[np.minimum(ends, len(data) - 1)]
    data, bounds = _without(data, bounds, starts[inner], ends[inner])
    starts, ends, text = word_spans(_symbols()[data] != 0, bounds)
    single = (ends - starts == 1) & _LETTER[data[starts]]
    near = single[1:] & single[:-1] & (text[1:] == text[:-1]) & (starts[1:] - ends[:-1] <= 2)
    run = np.cumsum(np.concatenate([[True], ~near])) if len(starts) else np.zeros(0, np.int64)
    long = np.flatnonzero(near & (np.bincount(run)[run] >= 3)[1:]) if len(starts) else np.zeros(0, np.int64)
    return _without(data, bounds, ends[long], starts[long + 1])


def _marked(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts with a word end before each and some behind, and the texts' new bounds."""
    marked = np.insert(data, bounds[:-1], np.uint8(32))
    return np.concatenate([marked, np.full(REACH + 1, 32, np.uint8)]), bounds + np.arange(len(bounds))


def _subsequences(symbols: np.ndarray):
    """For each of ``STEPS``: where subsequences start that stay within a word, its
    ends included, their slots, and their weight by how far they stretch."""
    n = len(symbols) - REACH
    symbols = symbols.astype(np.uint32)
    at = [symbols[k : k + n] for k in range(REACH + 1)]
    inside = np.ones(n, bool)
    reach = 1
    for i, j, k in STEPS:
        while reach < k:
            inside = inside & (at[reach] != 0)
            reach += 1
        code = ((at[0] * SYMBOLS + at[i]) * SYMBOLS + at[j]) * SYMBOLS + at[k]
        yield inside, (code * np.uint32(0x9E3779B1)) >> np.uint32(12), np.float32(DECAY ** (k - 3))


def _words(symbols: np.ndarray, bounds: np.ndarray):
    return word_spans(symbols != 0, bounds)


def word_scores(symbols: np.ndarray, bounds: np.ndarray, weights: np.ndarray):
    """Starts, ends, text numbers and kernel sums of all words."""
    value = np.zeros(len(symbols) - REACH, np.float32)
    for inside, number, weight in _subsequences(symbols):
        value += np.where(inside, weights[number], 0) * weight
    sums = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
    starts, ends, of = _words(symbols, bounds)
    return starts, ends, of, (sums[ends] - sums[starts - 1]) / np.sqrt(ends - starts + 1.0)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Explicit kernel features of single words, sorted by word: word number, slot, value."""
    coded = [w.encode() for w in words]
    data, bounds = _marked(np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], np.cumsum([len(c) for c in coded])]))
    of = np.repeat(np.arange(len(words)), np.diff(bounds))
    keys, values = [], []
    for inside, slot, weight in _subsequences(_symbols()[data]):
        at = np.flatnonzero(inside[: len(of)])
        keys.append(of[at] * SLOTS + slot[at])
        values.append(np.full(len(at), weight))
    keys, at = np.unique(np.concatenate(keys), return_inverse=True)
    values = np.bincount(at, np.concatenate(values), minlength=len(keys))
    word = keys // SLOTS
    return word, keys % SLOTS, values / np.sqrt(np.array([len(c) for c in coded])[word] + 1.0)


class Kernel:
    """Nyström features by landmark words."""

    def __init__(self, landmarks: list[str]):
        word, slot, value = features(landmarks)
        self.ids, row = np.unique(slot, return_inverse=True)
        self.rows = np.zeros((len(self.ids) + 1, len(landmarks)), np.float32)
        self.rows[row, word] = value
        gram = (self.rows.T @ self.rows).astype(float)
        value, vector = np.linalg.eigh(gram + 1e-3 * np.eye(len(gram)) * max(gram.diagonal().mean(), 1e-6))
        self.half = vector / np.sqrt(value) @ vector.T

    def map(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.rows.shape[1]))
        for start in range(0, len(words), 1000):
            word, slot, value = features(words[start : start + 1000])
            at = np.minimum(np.searchsorted(self.ids, slot), len(self.ids) - 1)
            known = np.flatnonzero(self.ids[at] == slot)
            if len(known):
                word, parts = word[known], self.rows[at[known]] * value[known, None].astype(np.float32)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                out[start + word[first]] = np.add.reduceat(parts, first)
        return out @ self.half

    def weights(self, beta: np.ndarray) -> np.ndarray:
        """The machine's weight of every possible subsequence."""
        table_ = np.zeros(SLOTS, np.float32)
        table_[self.ids] = self.rows[:-1] @ (self.half @ beta)
        return table_


def support_vectors(x: np.ndarray, y: np.ndarray, c: np.ndarray, margin: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and offset for the squared hinge loss, by Newton steps; ``y`` is 1 or -1,
    and ``margin`` how far each row is to lie from the boundary."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-4
    active = np.ones(len(x), bool)
    for _ in range(steps):
        a = x[active]
        w = np.linalg.solve(ridge + a.T @ (a * c[active, None]), a.T @ (c * y * margin)[active])
        now = y * (x @ w) < margin
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


class Model:
    """Subsequence weights, offset, and the line from the largest word score to a probability."""

    def __init__(self, weights: np.ndarray, offset: float = 0.0, slope: float = 1.0, shift: float = 0.0):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift

    def tops(self, column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Each text's largest word score, and that word; ``LOWEST`` without words."""
        data, bounds = _marked(*_joined(*text_bytes(column)))
        starts, ends, of, score = word_scores(_symbols()[data], bounds, self.weights)
        score = np.maximum(score + self.offset, LOWEST)
        top = np.full(len(column), LOWEST)
        np.maximum.at(top, of, score)
        witness = np.full(len(column), -1)
        held = np.flatnonzero(score == top[of])
        witness[of[held[::-1]]] = held[::-1]
        raw = data.tobytes()
        return top, [raw[starts[i] : ends[i]] if i >= 0 else b"" for i in witness]

    def probability(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -40, 40)))


def _line(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a lightly held logistic line, by damped Newton steps."""
    x = np.column_stack([top, np.ones(len(top))])
    w, hold, start = np.array([1.0, 0.0]), np.diag([1e-2, 1e-4]), np.array([4.0, 0.0])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * (w - start) @ hold @ (w - start)

    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + hold, x.T @ (p - y) + hold @ (w - start))
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w, before = w - size * step, now
        now = loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _sample(docs: DataFrame, labels: DataFrame, toxic: int, clean: int) -> DataFrame:
    """``(rid, text, toxic)`` of the labelled documents to learn from."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")
    known = known.filter(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    parts = [known.filter(F.col("toxic") == v).orderBy(*order).limit(n) for v, n in ((1, toxic), (0, clean))]
    chosen = staged(parts[0].union(parts[1]), "toxicity-labels")  # toxic + clean rows at most
    rows = staged(numbered(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "rid", "text", "toxic"), "toxicity-rows")
    one = rows.groupBy("doc_id").agg(F.min("rid").alias("rid")).select("rid")  # ids may repeat
    return staged(rows.join(F.broadcast(one), "rid", "left_semi").select("rid", "text", "toxic"), "toxicity-sample")


def _vocabulary(sample: DataFrame) -> DataFrame:
    """``(word, bad, good)``: in how many toxic and clean labelled sentences a word stands.
    A sentence that copies repeat counts once."""
    sentences = sample.select("toxic", F.explode(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n+")).alias("sentence"))
    words = F.array_distinct(F.split(F.lower("sentence"), r"[\x20\x09-\x0D]+"))
    each = sentences.distinct().select("toxic", F.explode(words).alias("word")).filter("word <> ''")
    return each.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))


def _bent(word: str) -> list[str]:
    """The word with a strange character put between its letters, once at each place."""
    return [f"{word[:i]}{sign}{word[i:]}" for i in range(1, len(word)) for sign in BENT_SIGNS] if len(word) > 3 else []


def _tops(sample: DataFrame, model: Model) -> DataFrame:
    def work(rows: pa.RecordBatch, _):
        top, witness = model.tops(rows.column(1))
        return rows.column(0), rows.column(2), top, [w.decode(errors="replace").lower() for w in witness]

    return map_texts(sample, "rid string, toxic int, top double, witness string", work)


def learn(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Train on the sentences of at most ``toxic`` and ``clean`` labelled documents.

    A sentence has its document's label, so most words of toxic sentences are
    harmless. A first machine takes words by how much more often toxic sentences hold
    them, and for those of many documents also forms with a strange letter put in. Then, in rounds, the highest word of each toxic document is its witness,
    the highest of each clean one a counter-example, and the machine learns anew.
    """
    blank = Model(np.zeros(SLOTS, np.float32), -1.0)
    sample = _sample(docs, labels, toxic, clean)
    vocabulary = staged(_vocabulary(sample), "toxicity-words")
    totals = vocabulary.agg(F.sum("bad"), F.sum("good")).first()
    if not totals[0] or not totals[1]:
        return blank
    odds = (F.col("bad") + 0.1) / (F.col("good") + 0.1) * (totals[1] / totals[0])
    ranked = vocabulary.withColumn("odds", odds).orderBy(F.desc(F.col("bad") * F.log("odds")), "word")
    suspects = ranked.filter("odds > 4 AND bad > 1").limit(SUSPECTS).collect() or ranked.filter("odds > 1").limit(20).collect()
    harmless = vocabulary.filter("good > 0").orderBy(F.xxhash64("word")).limit(VOCABULARY // 2).collect()
    common = vocabulary.filter("good > 0").orderBy(F.desc("good"), "word").limit(VOCABULARY // 4).collect()
    negatives = list(dict.fromkeys(r["word"] for r in [*common, *harmless]))
    bad = {r["word"]: float(r["bad"]) for r in suspects}
    sure = {r["word"]: float(r["bad"]) for r in suspects if r["odds"] > 20 and r["bad"] > 4}
    often = max(SURE, OFTEN * sample.filter("toxic = 1").count())
    best, least = blank, np.inf
    for _ in range(ROUNDS):
        good = [w for w in negatives if w not in bad]
        strong = sorted(bad, key=lambda w: (-bad[w], w))[: LANDMARKS // 2]
        kernel = Kernel(strong + good[: LANDMARKS - len(strong)])
        bent = [v for w in strong if bad.get(w, 0) + sure.get(w, 0) >= often and w.isalpha() for v in _bent(w)]
        words = [*bad, *bent, *good]
        y = np.array([1.0] * (len(bad) + len(bent)) + [-1.0] * len(good))
        c = COST * np.array([len(good) / len(bad) * 0.2 + 1.0] * len(bad) + [BENT_COST] * len(bent) + [1.0] * len(good))
        margin = np.array([1.0] * len(bad) + [BENT_MARGIN] * len(bent) + [1.0] * len(good))
        beta, offset = support_vectors(kernel.map(words), y, c, margin)
        model = Model(kernel.weights(beta), offset)
        rows = _tops(sample, model).select("top", "toxic", "witness").toPandas()  # toxic + clean rows at most
        top, truth = rows["top"].to_numpy(float), rows["toxic"].to_numpy(float)
        slope, shift = _line(top, truth)
        loss = np.logaddexp(0, np.where(truth == 1, -1, 1) * (slope * top + shift)).mean()
        if loss < least:
            best, least = Model(model.weights, model.offset, slope, shift), loss
        rows = rows[rows["witness"] != ""]
        said = {w: {0: 0, 1: 0} for w in sorted(set(rows["witness"]))}
        for w, t in zip(rows["witness"], rows["toxic"]):
            said[w][int(t)] += 1
        seen = {w: float(s[1]) for w, s in said.items() if s[1] > 4 * s[0]}
        bad = {w: n for w, n in sure.items() if said.get(w, {0: 0})[0] == 0} | seen or bad
        counter = sorted((w for w, s in said.items() if s[1] <= s[0]), key=lambda w: (-said[w][0], w))
        negatives = list(dict.fromkeys(counter + negatives))
    return best


def scorer(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN):
    """A function from a text column to its score, after learning from ``docs``."""
    found = learn(docs, labels, toxic, clean)
    sent = docs.sparkSession.sparkContext.broadcast((found.weights, found.offset, found.slope, found.shift))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Model(*sent.value)
        for texts in batches:
            rows = pa.RecordBatch.from_arrays([texts], names=["text"])
            size = np.diff(text_bytes(texts)[1])
            parts = [model.probability(model.tops(part.column(0))[0]) for part in slices(rows, size, CHUNK_BYTES)]
            yield pa.array(np.concatenate([*parts, np.zeros(0)]), type=pa.float64())

    return score


def scored(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> DataFrame:
    """``(rid, doc_id, held_out, score, predicted)`` per document.

    A document is as toxic as its most toxic word-long stretch. The kernel counts
    subsequences of four characters with gaps, so inserted or changed characters
    leave most of an insult's subsequences in place; summed over landmarks, the
    machine is one weight per subsequence, and every character of every text is
    scored. Only the learning uses a bounded sample. Of several labels of an id the
    largest counts; null labels and ids are skipped; without labels of both kinds all
    scores are low. Null and empty texts get the lowest score there is.
    """
    score = scorer(docs, labels, toxic, clean)
    out = numbered(docs).select("rid", "doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rid")
