"""Language-model scores by Katz backoff.

The model predicts classes of tokens: each of the most frequent training words, the end, and one class for all rarer words,
inside which a word has its add-one share. A class after a context (the class before it, or the start of a text) has its
Good-Turing discounted share where the pair was seen; else the context's backoff weight times the class's share without
context. Backoff weights make every context's distribution sum to exactly one. Counts and pair probabilities are stored
tables, partitioned by key; what goes to all tasks (classes, weights, the most frequent pairs) has fixed bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.llm.common import columns, mix, most_frequent, shuffle_partitions, stored, text_slices, word_hashes
from doclake.session import ship_with_tasks, work_dir

ship_with_tasks(__name__)

RARE, END, START, WORDS = 0, 1, 2, 3
END_KEY = np.uint64(0x454E44)
SHIFT = 24
#: Tokens and texts that a task counts together before it hands them on.
TOKENS_TOGETHER, TEXTS_TOGETHER = 700_000, 30_000
#: Partitions of the pair table are those of a shuffle, but so many at least: a text gets a row of sums from each of them
#: that it has a token in, and this should follow the number of texts, not that of partitions as well.
LEAST_PARTS = 64
#: Counts up to this are discounted.
TRUSTED = 5


@dataclass(frozen=True)
class Model:
    """Of fixed size: ``words`` sorted hashes of the class words, log10 shares and weights by class, the most frequent pairs."""

    n_tokens: int
    n_distinct: int
    words: np.ndarray
    word_counts: np.ndarray
    end_count: int
    rare_total: int
    rare_distinct: int
    share: np.ndarray
    backoff: np.ndarray
    pair_keys: np.ndarray
    pair_logs: np.ndarray
    table: str
    parts: int


def token_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of all tokens of a slice: each row's words and an end."""
    keys, rows, _, _ = word_hashes(data, offsets)
    n = len(offsets) - 1
    out, of = np.empty(len(keys) + n, np.uint64), np.empty(len(keys) + n, np.int64)
    at = np.arange(len(keys)) + rows
    ends = np.cumsum(np.bincount(rows, minlength=n) + 1) - 1
    out[at], of[at] = keys, rows
    out[ends], of[ends] = END_KEY, np.arange(n)
    return out, of


def token_batches(batches: Iterator[pa.RecordBatch], training: bool) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, token hashes, row of each token) of many texts at a time; with ``training`` of training texts only."""
    parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
    tokens = texts = 0

    def joined():
        first = np.cumsum([0, *[p[0].num_rows for p in parts]])
        return (pa.Table.from_batches([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] + f for p, f in zip(parts, first)]))

    for batch in batches:
        if training:
            batch = batch.filter(batch.column("train"))
        rest = batch.select([n for n in batch.schema.names if n != "text"])
        for a, b, data, offsets in text_slices(batch.column("text")):
            keys, rows = token_keys(data, offsets)
            if parts and (tokens + len(keys) > TOKENS_TOGETHER or texts + b - a > TEXTS_TOGETHER):
                yield joined()
                parts, tokens, texts = [], 0, 0
            parts.append((rest.slice(a, b - a), keys, rows))
            tokens, texts = tokens + len(keys), texts + b - a
    if parts:
        yield joined()


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, keys, _ in token_batches(batches, True):
        word, n = np.unique(keys, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["w", "n"])


def class_ids(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    at = np.searchsorted(words, keys)
    found = words[np.minimum(at, len(words) - 1)] == keys if len(words) else np.zeros(len(keys), bool)
    return np.where(keys == END_KEY, END, np.where(found, at + WORDS, RARE)).astype(np.int64)


def pair_keys(classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Context and class of every token in one number."""
    before = np.empty_like(classes)
    before[:1] = START
    before[1:] = np.where(rows[1:] == rows[:-1], classes[:-1], START)
    return before << SHIFT | classes


def count_pairs(batches: Iterator[pa.RecordBatch], words: np.ndarray) -> Iterator[pa.RecordBatch]:
    for _, keys, rows in token_batches(batches, True):
        pair, n = np.unique(pair_keys(class_ids(keys, words), rows), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n, pa.int64())], ["key", "n"])


def discounts(of: dict[int, int]) -> list[float]:
    """Factors of counts 1 to ``TRUSTED`` from how many pairs have each count, after Katz.

    Where the counts of counts give no factor between 0 and 1, that of absolute discounting stands in.
    """
    n = [0] + [of.get(r, 0) for r in range(1, TRUSTED + 2)]
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    absolute = min(max(absolute, 0.05), 0.95)
    common = (TRUSTED + 1) * n[TRUSTED + 1] / n[1] if n[1] else 1.0
    out = []
    for r in range(1, TRUSTED + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else -1.0
        out.append(d if 0 < d < 1 else (r - absolute) / r)
    return out


def fit(texts: DataFrame, text: str, train: Column, classes: int = 1 << 14, pairs_at_hand: int = 1 << 16) -> Model:
    """The model of the rows for which ``train`` holds. Null texts are empty: an end alone.

    ``classes`` bounds the words that are classes of their own, ``pairs_at_hand`` the pairs that go to all tasks; every
    word and every pair is counted in any case.
    """
    spark = texts.sparkSession
    source = texts.select(F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    words = stored(source.mapInArrow(count_words, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "word-counts")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    no_end = words.where(F.col("w") != int(END_KEY))
    least = most_frequent(no_end, classes)
    got, counts = columns(no_end.where(F.col("n") >= least), "w", "n")
    order = np.argsort(got.view(np.uint64))
    known, counts = got.view(np.uint64)[order], counts[order]
    ends = int(words.where(F.col("w") == int(END_KEY)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    rare_total, rare_distinct = int(total - ends - counts.sum()), int(distinct - len(known) - (ends > 0))

    pairs = stored(source.mapInArrow(lambda b: count_pairs(b, known), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")
    of = {row["n"]: row["k"] for row in pairs.where(F.col("n") <= TRUSTED + 1).groupBy("n").agg(F.count("*").alias("k")).collect()}
    factor = discounts(of)
    # classes without context: add-one, so that none has no share
    class_counts = np.concatenate([[rare_total, ends, 0], counts]).astype(np.float64)
    predicted = np.ones(len(class_counts), bool)
    predicted[START] = False
    share = np.where(predicted, (class_counts + 1) / (class_counts.sum() + predicted.sum()), 0.0)
    shares = spark.createDataFrame(pa.table({"x": np.arange(len(share)), "share": share}))
    by_pair = pairs.select("key", "n", F.shiftright("key", SHIFT).alias("h"), F.col("key").bitwiseAND((1 << SHIFT) - 1).alias("x"))
    kept = F.col("n") * F.coalesce(*[F.when(F.col("n") == r, F.lit(d)) for r, d in enumerate(factor, 1)], F.lit(1.0))
    by_pair = by_pair.join(F.broadcast(shares), "x").withColumn("kept", kept)  # one row a class
    by_context = by_pair.groupBy("h").agg(F.sum("n").alias("c"), F.sum("kept").alias("kept"), F.sum("share").alias("seen"), F.count("*").alias("k"))
    # a context without small counts keeps one more count for what did not follow it; one that all classes follow keeps none
    full = F.col("k") == int(predicted.sum())
    base = F.when(full, F.col("kept")).when(F.col("c") - F.col("kept") < 1e-9 * F.col("c"), F.col("c") + 1.0).otherwise(F.col("c").cast("double"))
    by_context = stored(by_context.withColumn("base", base).withColumn(
        "backoff", F.when(full, 0.0).otherwise((1 - F.col("kept") / F.col("base")) / (1 - F.col("seen")))), "contexts")
    parts = max(shuffle_partitions(spark), LEAST_PARTS)
    logs = by_pair.join(F.broadcast(by_context.select("h", "base")), "h").select(  # at most one row a class
        "key", "n", F.log10(F.col("kept") / F.col("base")).alias("log"))
    logs = logs.mapInArrow(lambda b: with_part(b, parts), "key long, n long, log double, part int")
    folder = work_dir(spark, "pair-logs")
    logs.repartition(parts, "part").write.partitionBy("part").parquet(folder)
    table = spark.read.schema("key long, n long, log double, part int").parquet(folder)
    keys, values = columns(table.where(F.col("n") >= most_frequent(table, pairs_at_hand)), "key", "log")
    order = np.argsort(keys)
    h, weight = columns(by_context, "h", "backoff")
    backoff = np.ones(len(share))
    backoff[h.astype(np.int64)] = weight
    with np.errstate(divide="ignore"):
        return Model(int(total), int(distinct), known, counts, ends, rare_total, rare_distinct, np.log10(share), np.log10(backoff), keys[order], values[order], folder, parts)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Partition of a key, in the stored table and for those who ask."""
    return (mix(keys.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def with_part(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part_of(b.column("key").to_numpy(), parts), pa.int32())], [*b.schema.names, "part"])


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return at, (sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool))


def grouped(keys: np.ndarray, rows: np.ndarray, part: np.ndarray, parts: int):
    """For each part the different keys, how often each occurs, and the rows it occurs in."""
    order = np.lexsort((keys, part))
    keys, rows, part = keys[order], rows[order], part[order]
    at = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        k, r = keys[at[p]: at[p + 1]], rows[at[p]: at[p + 1]]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
        yield p, k[first], np.diff(np.append(first, len(k))), r


ASKED = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("score", pa.float64()), ("base", pa.float64()), ("known", pa.int64()),
                   ("rows", pa.list_(pa.int64())), ("rows_train", pa.list_(pa.bool_())), ("keys", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), ("at", pa.list_(pa.int16())),
                   ("words", pa.list_(pa.int64())), ("word_times", pa.list_(pa.int32())), ("word_at", pa.list_(pa.int16()))])
ASKED_DDL = ("part int, row long, train boolean, n_tokens long, score double, base double, known long, rows array<long>, rows_train array<boolean>, "
             "keys array<long>, times array<int>, at array<short>, words array<long>, word_times array<int>, word_at array<short>")


def ask(batches: Iterator[pa.RecordBatch], m: Model, parts: int) -> Iterator[pa.RecordBatch]:
    """For every text what this task knows of its scores; for every part the pairs and rare words that it must look up."""
    for table, keys, rows in token_batches(batches, False):
        n = table.num_rows
        ids, train = table.column("row").to_numpy(), table.column("train").to_numpy(zero_copy_only=False)
        classes = class_ids(keys, m.words)
        pairs = pair_keys(classes, rows)
        at, here = lookup(pairs, m.pair_keys)
        score = np.bincount(rows[here], m.pair_logs[at[here]], n) if len(m.pair_logs) else np.zeros(n)
        counts = np.concatenate([[0, m.end_count, 0], m.word_counts])
        common = classes != RARE
        base = np.bincount(rows[common], np.log10(counts[classes[common]] + 1.0), n)
        known = np.bincount(rows[common & (counts[classes] > 0)], minlength=n)
        length = np.bincount(rows, minlength=n)
        home = (mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(home), pa.array(ids), pa.array(train), pa.array(length, pa.int64()), pa.array(score), pa.array(base), pa.array(known, pa.int64()), *[pa.nulls(n, f.type) for f in list(ASKED)[7:]]], schema=ASKED)
        open_ = ~here
        by_pair = grouped(pairs[open_], rows[open_], part_of(pairs[open_], parts), parts)
        rare = ~common
        by_word = grouped(keys[rare], rows[rare], (mix(keys[rare]) % np.uint64(parts)).astype(np.int64), parts)
        for (p, k, t, r), (_, w, wt, wr) in zip(by_pair, by_word):
            if len(k) or len(w):
                used, back = np.unique(np.concatenate([r, wr]), return_inverse=True)
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p], pa.int32()), *[pa.nulls(1, f.type) for f in list(ASKED)[1:7]], one(ids[used], pa.int64()), one(train[used], pa.bool_()), one(k, pa.int64()), one(t.astype(np.int32), pa.int32()),
                     one(back[:len(r)].astype(np.int16), pa.int16()), one(w.view(np.int64), pa.int64()), one(wt.astype(np.int32), pa.int32()), one(back[len(r):].astype(np.int16), pa.int16())], schema=ASKED)


def answer(asked: pa.Table, table: pa.Table, m: Model) -> pa.Table:
    """Of one part: sums of logs for every text that asked, Katz's recursion for each of its tokens.

    A pair in the table has its log; any other the context's weight and the class's share. A rare word adds its share of
    its class, from the training occurrences of all tasks, which meet here.
    """
    order = np.argsort(table.column("key").to_numpy())
    keys, logs = table.column("key").to_numpy()[order], table.column("log").to_numpy()[order]
    text = asked.filter(pc.is_valid(asked.column("row"))).select(["row", "train", "n_tokens", "score", "base", "known"])
    out = [text.append_column("copies", pa.array(np.ones(text.num_rows, np.int64)))]
    packs = [{c: asked.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ASKED.names[7:]} for i in np.flatnonzero(asked.column("row").is_null().to_numpy(zero_copy_only=False))]
    word = np.concatenate([p["words"] for p in packs]) if packs else np.zeros(0, np.int64)
    seen = np.concatenate([np.add.reduceat(p["rows_train"][p["word_at"]].astype(np.int64), np.cumsum(p["word_times"]) - p["word_times"]) if len(p["words"]) else np.zeros(0, np.int64) for p in packs]) if packs else word
    every, where = np.unique(word, return_inverse=True)
    count = np.bincount(where, seen, len(every)).astype(np.int64)[where]
    rare_log = np.log10(m.rare_total + m.rare_distinct + 1)
    first = 0
    for p in packs:
        n = len(p["rows"])
        at, found = lookup(p["keys"], keys)
        value = m.backoff[p["keys"] >> SHIFT] + m.share[p["keys"] & ((1 << SHIFT) - 1)]
        if len(logs):
            value = np.where(found, logs[at], value)
        score = np.bincount(p["at"], np.repeat(value, p["times"]), n).astype(np.float64)  # of nothing it counts in whole numbers
        c = count[first: first + len(p["words"])]
        first += len(p["words"])
        word_log = np.bincount(p["word_at"], np.repeat(np.log10(c + 1.0), p["word_times"]), n).astype(np.float64)
        words = np.bincount(p["word_at"], minlength=n)
        known = np.bincount(p["word_at"], np.repeat(c > 0, p["word_times"]), n).astype(np.int64)
        out.append(pa.table({"row": p["rows"], "train": pa.nulls(n, pa.bool_()), "n_tokens": pa.nulls(n, pa.int64()), "score": score + word_log - words * rare_log, "base": word_log, "known": known, "copies": np.zeros(n, np.int64)}))
    return pa.concat_tables(out)


def score_texts(texts: DataFrame, id: str, text: str, train: Column, model: Model) -> DataFrame:
    """(id, train, n_tokens, n_known, base_score, score): one row for every row of ``texts``.

    ``score`` is the model's log10 probability of the text, ``base_score`` the sum of log10((c + 1) / (N + V + 1)) over its
    tokens. ``train`` must be that of ``fit`` over the same rows, as rare words' counts are summed here again. Null texts
    are an end alone; repeated rows have rows of their own; other columns are not read; no rows give none.

    Texts stay where they are read: only different pairs and rare words of many texts at a time, with the texts they occur
    in, travel to the model's partitions, and sums for each text come back.
    """
    spark = texts.sparkSession
    parts = model.parts
    mark = F.coalesce(train, F.lit(False))
    source = texts.select(F.col(id).alias("id"), F.xxhash64(F.col(id), F.col(text), mark).alias("row"), mark.alias("train"), F.col(text).alias("text"))
    asked = source.select("row", "train", "text").mapInArrow(lambda b: ask(b, model, parts), ASKED_DDL)
    table = spark.read.schema("key long, n long, log double, part int").parquet(model.table).select("part", "key", "log")
    found = asked.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(
        lambda a, t: answer(a, t, model), "row long, train boolean, n_tokens long, score double, base double, known long, copies long")
    sums = found.groupBy("row").agg(F.sum("copies").alias("copies"), F.max("train").alias("train"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    # equal rows share a key; each of them has asked
    all_tokens = float(np.log10(model.n_tokens + model.n_distinct + 1))
    sums = sums.select("row", "train", "n_tokens", (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
                       (F.col("base") / F.col("copies") - F.col("n_tokens") * all_tokens).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))
    return source.select("id", "row").join(sums, "row").drop("row")
