"""Spelling variants: words of a corpus that differ by one inserted, deleted or replaced code point, found in rotations.

A word with a mark at its end has one rotation for every place. The rotation that begins behind a character ends with it, so
what stands before that last character is the same for all words that differ only there: replacements are the rotations
with that prefix and one more character, the word without the character is the rotation that is the prefix itself. Rows
with one prefix are a group; a group has at most one row for each letter of the alphabet and one more, whatever the corpus. Sorted
groups are scanned once for counts and best neighbours; pairs are never written out.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from doclake.llm.common import stored
from doclake.operators.ordering import with_position
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

#: Words are runs of these, lower-cased in A-Z only.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
MARK = "\x01"
#: Rotations of longer words are stood for by digests of their two parts.
LITERAL = 64
#: Different words that a task counts together, and code points of a text that are cut into words at a time.
WORDS_TOGETHER, CHUNK = 300_000, 1 << 20


def chunks(text: str, most: int) -> Iterator[str]:
    """Parts of a text of about ``most`` code points that end between words, or inside of none."""
    first = 0
    while len(text) - first > most:
        cut = first + most
        inside = RUN.match(text, cut)
        cut = inside.end() if inside else cut
        yield text[first:cut]
        first = cut
    yield text[first:]


def count_words(batches: Iterator[pa.RecordBatch], every: int, least_length: int) -> Iterator[pa.RecordBatch]:
    """(word, n) of many texts at a time. Equal words of one text are edited alike, so they are edited once."""
    tally: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(tally.keys(), pa.string()), pa.array(tally.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        ids, texts = batch.column("id"), batch.column("text")
        for i in range(batch.num_rows):
            text = texts[i].as_py()
            if not text:
                continue
            start = zlib.crc32(f"{ids[i].as_py() if ids[i].is_valid else ''}:".encode())
            for part in chunks(text, CHUNK):
                for run, n in Counter(RUN.findall(part.encode().lower().decode())).items():  # bytes: A-Z only
                    h = zlib.crc32(run.encode(), start)
                    if h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                    if len(run) >= least_length:
                        tally[run] += n
                if len(tally) >= WORDS_TOGETHER:
                    yield out()
                    tally = Counter()
    yield out()


def words_of(texts: DataFrame, id: str, text: str, every: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the words of all texts that occur often enough.

    A run loses the code point at crc32 modulo its length where ``every`` divides the crc32 of ``<id>:<run>``; a null id is
    empty there. Repeated rows count each. Counts are combined in the tasks that read, so a common word travels once a task.
    """
    source = texts.select(F.col(id).cast("string").alias("id"), F.col(text).alias("text"))
    counted = source.mapInArrow(lambda b: count_words(b, every, least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def long_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``rotations`` for long words: 128-bit digests of what stands before and behind each place, each read once."""

    def running(text: str) -> list[bytes]:
        state, out = hashlib.blake2b(digest_size=16), []
        for c in ["", *text]:
            state.update(c.encode("utf-32-le"))
            out.append(state.digest())
        return out

    for batch in batches:
        for i in range(batch.num_rows):
            id, n, word = (batch.column(c)[i].as_py() for c in ("id", "n", "word"))
            before, behind = running(word), running(word[::-1])[::-1]
            rows = [(f"{k}:{before[k].hex()}{behind[k].hex()}", False, None) for k in range(len(word) + 1)]
            if len(word) - 1 > LITERAL:
                rows += [(f"{k}:{before[k].hex()}{behind[k + 1].hex()}", True, k == 0 or word[k - 1] != word[k]) for k in range(len(word))]
            for a in range(0, len(rows), 10_000):
                key, longer, first = zip(*rows[a: a + 10_000])
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(longer, pa.bool_()), pa.array(first, pa.bool_()), pa.array([id] * len(key), pa.int64()),
                                                  pa.array([n] * len(key), pa.int64())], ["key", "longer", "first", "id", "n"])


def rotations(words: DataFrame) -> DataFrame:
    """(key, longer, first, id, n): every rotation of every word, once as the prefix of others and once without its last character.

    ``longer`` rows have one character behind the key. ``first`` marks the first of equal neighbouring characters: dropping
    any of them leaves the same word, which counts once. Keys of up to ``LITERAL`` characters are the rotations
    themselves, longer ones digests with their place; which of them holds depends on the key's own length.
    """
    length, k, word = F.length("word"), F.col("k"), F.col("word")

    def cut(first: Column, size: Column) -> Column:
        return F.substring(word, first, size)

    # k from 0 to length: the rotation at k; the rest: the rotation behind character k - length, without it
    at = F.col("at")
    spread = words.where(length <= LITERAL + 1).withColumn("k", F.explode(F.sequence(F.lit(0), 2 * length))).withColumn("longer", k > length).withColumn("at", F.when(F.col("longer"), k - length - 1).otherwise(k))
    key = F.concat(F.when(F.col("longer"), cut(at + 2, length)).otherwise(cut(at + 1, length)), F.lit(MARK), cut(F.lit(1), at))
    first = F.when(F.col("longer"), (at == 0) | (cut(at, F.lit(1)) != cut(at + 1, F.lit(1))))
    literal = spread.where(length - F.col("longer").cast("int") <= LITERAL).select(key.alias("key"), "longer", first.alias("first"), "id", "n")
    return literal.unionByName(words.where(length > LITERAL).select("id", "n", "word").mapInArrow(long_rotations, literal.schema))


def neighbours(words: DataFrame) -> DataFrame:
    """(id, n_near, best): of every word that has near words their number and (minus count, id) of the first of them.

    One exchange by key and one sort: a row's best neighbour is its group's first other row in order of count and word.
    """
    rows = rotations(words)
    by_key, in_order = Window.partitionBy("key"), Window.partitionBy("key").orderBy(F.col("longer").desc(), F.col("n").desc(), "id")
    me, longer, first = F.struct((-F.col("n")).alias("minus"), F.col("id").alias("id")), F.col("longer"), F.coalesce("first", F.lit(False))
    rows = rows.withColumns({"rank": F.row_number().over(in_order), "next": F.lead(F.when(longer, me)).over(in_order)})
    rows = rows.withColumns({
        "others": F.sum(longer.cast("long")).over(by_key), "top": F.min(F.when(longer, me)).over(by_key), "base": F.min(F.when(~longer, me)).over(by_key),
        "firsts": F.sum(first.cast("long")).over(by_key), "top_first": F.min(F.when(first, me)).over(by_key)})
    same = F.when(longer, F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("top")))
    near = rows.select("id", F.when(longer, F.col("others") - 1 + (first & F.col("base").isNotNull()).cast("long")).otherwise(F.col("firsts")).alias("k"),
                       F.when(longer, F.least(same, F.when(first, F.col("base")))).otherwise(F.col("top_first")).alias("best"))
    return near.where("k > 0").groupBy("id").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form): where following forms ends. Each step doubles the distance, counts double along a chain, so steps are few."""
    now = forms.select("id", F.col("form").alias("root"))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("on"))
        step = stored(now.join(on, "root", "left").select("id", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "variant-roots")
        now = step.select("id", "root")
        if not step.where("moved").head(1):
            return now


def spelling_variants(texts: DataFrame, id: str, text: str, every: int = 97, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row for every word of ``words_of``.

    ``form`` is the near word of largest count (ties: smallest in code-point order) if it has at least twice the word's,
    ``root`` where forms lead to, the word itself where it has none. Null and empty texts have no words, texts and
    words of any length are taken whole; other columns are not read; no rows give none.

    Words are numbered in code-point order, so rows of rotations hold numbers and ties are settled by them.
    """
    counted = stored(words_of(texts, id, text, every, least_length, least_count), "variant-words")
    words = stored(with_position(counted, F.col("word"), name="id").select("id", "word", "n"), "variant-ids")
    near = stored(neighbours(words), "variant-near")
    chosen = near.join(words.select("id", "n"), "id").select("id", "n_near", F.when(-F.col("best.minus") >= 2 * F.col("n"), F.col("best")).alias("best"))
    chosen = stored(chosen.select("id", "n_near", F.col("best.id").alias("form"), (-F.col("best.minus")).alias("form_n")), "variant-forms")
    roots = last_forms(chosen.where("form is not null"))
    linked = chosen.join(roots, "id", "left")
    named = words.select("id", "word")
    # words that are the form or the root of many have one row each on the other side
    form = linked.where("form is not null").join(named.select(F.col("id").alias("form"), F.col("word").alias("form_word")), "form")
    form = form.join(named.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "form_word", "root_word")
    out = words.join(chosen.select("id", "n_near", "form_n"), "id", "left").join(form, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
