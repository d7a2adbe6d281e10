"""Quality classifier: supervised subword embeddings.

Words, character n-grams and immediate word repetitions are hashed to rows of an embedding matrix; a document is the average
of its rows, a softmax layer turns it into class probabilities. Trained by stochastic gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import BASE, BYTE_VALUES, LOWER, SPACE, mix, text_slices, word_hashes
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

#: Bytes of text whose features are found together: arrays of about 80 times that many bytes live meanwhile.
SLICE = 1 << 18


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` and ``sample_features`` bound what is learnt from: the labelled rows first in hash order."""

    bits: int = 17
    dim: int = 16
    grams: tuple[int, ...] = (3, 4)
    epochs: int = 12
    rate: float = 0.5
    sample_rows: int = 6000
    sample_features: int = 16_000_000
    seed: int = 5


def features(data: np.ndarray, offsets: np.ndarray, bits: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, row) of all features of a slice of texts."""
    shift = np.uint64(64 - bits)
    words, rows, _, _ = word_hashes(data, offsets)
    out, at = [mix(words) >> shift], [rows]
    same = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    if same.any():  # one feature says that a word repeats the one before, whatever word it is
        out.append(np.full(int(same.sum()), mix(np.array([77], np.uint64))[0] >> shift, dtype=np.uint64))
        at.append(rows[1:][same])
    values = BYTE_VALUES[LOWER[data]]
    spaces = np.concatenate([[0], np.cumsum(SPACE[data], dtype=np.int64)])
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    with np.errstate(over="ignore"):
        for n in grams:
            if len(data) < n:
                continue
            m = len(data) - n + 1
            h = np.full(m, n, dtype=np.uint64)
            for k in range(n):
                h = h * BASE + values[k: k + m]
            fine = (spaces[n:] == spaces[:m]) & (row_of[n - 1:] == row_of[:m])
            out.append(mix(h[fine]) >> shift)
            at.append(row_of[:m][fine])
    return np.concatenate(out).astype(np.int64), np.concatenate(at)


def featurize(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """Distinct features and counts of every text, as a compressed cell: one task gets all of the sample."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for a, b, data, offsets in text_slices(batch.column("text"), SLICE):
            f, rows = features(data, offsets, s.bits, s.grams)
            keys, counts = np.unique((rows << s.bits) | f, return_counts=True)
            ends = np.searchsorted(keys, np.arange(b - a + 1) << s.bits).tolist()
            ids, counts = (keys & ((1 << s.bits) - 1)).astype("<i4"), counts.astype("<i4")
            cells = [press.compress(np.diff(ids[i:j], prepend=np.int32(0)).tobytes() + counts[i:j].tobytes()) for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("order").slice(a, b - a), batch.column("y").slice(a, b - a), pa.array(cells, pa.binary())], ["order", "y", "cell"])


def unfolded(cell: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(distinct features, their shares of the text's features) of a cell."""
    steps, counts = np.frombuffer(zstandard.ZstdDecompressor().decompress(cell), "<i4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.int32), (counts / max(1, counts.sum())).astype(np.float32)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], s: Settings, classes: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and biases after ``epochs`` passes in a seeded random order with a falling rate."""
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    weights, bias = np.zeros((s.dim, classes), np.float32), np.zeros(classes, np.float32)
    steps, done = max(1, s.epochs * len(rows)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            y, ids, share = rows[i]
            rate = s.rate * (1 - done / steps)
            done += 1
            x = share @ table[ids] if len(ids) else np.zeros(s.dim, np.float32)
            z = x @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            down = weights @ p
            weights -= rate * np.outer(x, p)
            bias -= np.float32(0.1 * rate) * p
            if len(ids):  # the gradient of an average reaches its rows by their share; as usual it is not divided by their number
                table[ids] -= np.float32(rate) * np.outer(np.minimum(share * np.float32(len(ids)), 4), down)
    return table, weights, bias


def train(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """One task: it reads the bounded sample in hash order and returns one score weight for each hashed feature."""
    rows, taken = [], 0
    found = [(o.as_py(), y.as_py(), *unfolded(c.as_py())) for batch in batches for o, y, c in zip(batch.column("order"), batch.column("y"), batch.column("cell"))]
    for _, y, ids, share in sorted(found, key=lambda r: (r[0], r[1], len(r[2]))):
        taken += len(ids)
        if taken > s.sample_features and rows:
            break
        rows.append((int(y), ids, share))
    del found
    table, weights, bias = fit(rows, s)
    # two classes: the difference of the logits is an average of one number a feature
    line = table.astype(np.float64) @ (weights[:, 1] - weights[:, 0]).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array([line.tobytes()], pa.binary()), pa.array([float(bias[1] - bias[0])])], ["line", "bias"])


def learn(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Score weights of the hashed features and a bias, from whole texts of labelled rows.

    Labels other than 0 and 1 and null ids are ignored; of several labels of an id the smaller counts. The sampled labels
    (at most ``sample_rows``) are broadcast, texts are never shuffled; the model of fixed size reaches the driver.
    Without labelled texts every score is 0.5.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.min(label).cast("int").alias("y"))
    sample = known.withColumn("order", F.xxhash64("_id")).orderBy("order", "_id").limit(s.sample_rows)
    rows = docs.select(F.col(id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(sample), "_id").select("order", "y", "text")
    model = rows.mapInArrow(lambda b: featurize(b, s), "order long, y int, cell binary")
    got = model.repartition(1).mapInArrow(lambda b: train(b, s), "line binary, bias double").first()
    return np.frombuffer(got["line"]), got["bias"]


def score_batches(batches: Iterator[pa.RecordBatch], text: str, keep: list[str], line: np.ndarray, bias: float, s: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.empty(batch.num_rows)
        for a, b, data, offsets in text_slices(batch.column(text), SLICE):
            f, rows = features(data, offsets, s.bits, s.grams)
            total = np.bincount(rows, line[f], b - a)
            number = np.bincount(rows, minlength=b - a)
            out[a:b] = 1 / (1 + np.exp(-(total / np.maximum(number, 1) + bias)))
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(out)], [*keep, "score"])


def score_quality(docs: DataFrame, text: str, model: tuple[np.ndarray, float], s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``score``, the probability of label 1, added.

    Every row stays, repeated ones too; a null text scores like an empty one, by the bias alone. A column ``score`` is
    replaced. The score reads the text only.
    """
    names = [c for c in (keep if keep is not None else docs.columns) if c != "score"]
    # a text that is not kept travels to the workers, not back
    rows = docs.select(*names, *([] if text in names else [text]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    line, bias = model
    return rows.mapInArrow(lambda b: score_batches(b, text, names, line, bias, s), f"{schema + ', ' if schema else ''}score double")


def held_out(crc: Column) -> Column:
    return crc % 3 == 1
