"""Byte-level BPE encoding and decoding by recursive queries.

Every Python worker holds the merge table in a DuckDB of its own process. Different pieces of its partitions become
token-position rows; a recursive query joins neighbours to the merge table and contracts each piece's leftmost pair of least
rank until nothing joins. Decoding is an ordered aggregation of token bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclake.llm.pieces import PieceTable, gather, piece_texts, pieces, slices_of_points, worker_state
from doclake.session import ship_with_tasks

ship_with_tasks(__name__)

#: Rounds of contraction in one recursive query; longer pieces go on from its last state, so memory stays bounded.
ROUNDS = 40
SLICE = 2 << 20

# it: round; a round keeps only pieces in which something joined. A pair that repeats in a piece is contracted at every
# place at once where no pair with the new token can rank before it (merges.alone is false); of a run of equal tokens
# every second pair from the left.
RECURSION = """
with recursive state(piece, pos, tok, it) as (
  select piece, pos, tok, 0 from start
  union all (
    with near as (
      select piece, pos, tok, it, lead(tok) over w as next, row_number() over w as nth from state window w as (partition by piece order by pos)
    ), pairs as (
      select n.piece, n.pos, n.nth, m.id, m.alone, n.tok = n.next as twins from near n join merges m on m.l = n.tok and m.r = n.next
    ), least as (select piece, min(id) as id from pairs group by piece
    ), chosen as (
      select p.piece, p.pos, p.nth, p.id, p.alone, p.twins, row_number() over (partition by p.piece order by p.pos) as k
      from pairs p join least l on l.piece = p.piece and l.id = p.id
    ), islands as (
      select *, row_number() over (partition by piece, nth - k order by pos) as step from chosen
    ), joined as (
      select piece, nth, id from islands where case when alone then k = 1 when twins then step % 2 = 1 else true end
    )
    select n.piece, n.pos, coalesce(j.id, n.tok), n.it + 1
    from near n join least l on l.piece = n.piece
      left join joined j on j.piece = n.piece and j.nth = n.nth
      left join joined g on g.piece = n.piece and g.nth + 1 = n.nth
    where g.nth is null and n.it < {rounds}
  )
), ends as (select piece, max(it) as it from state group by piece)
select s.piece, s.pos, s.tok, s.it from state s join ends e on e.piece = s.piece and e.it = s.it
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in content.splitlines() if line)}


class Codec:
    """The merge table of one vocabulary in an in-process DuckDB."""

    def __init__(self, content: bytes, memory: str = "300MB"):
        import duckdb

        ranks = read_ranks(content)
        self.db = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": memory})
        self.bytes_id = np.full(256, -1, dtype=np.int32)
        for t, r in ranks.items():
            if len(t) == 1:
                self.bytes_id[t[0]] = r
        if (self.bytes_id < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        split = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, made = (np.array(x, dtype=np.int32) for x in zip(*split)) if split else (np.zeros(0, np.int32),) * 3
        # a token with which a pair of lower rank exists must be made one at a time
        alone = np.isin(made, np.unique(np.concatenate([l[made < l], r[made < r]])))
        self.load("merges", {"l": l, "r": r, "id": made, "alone": alone})
        self.load("vocabulary", {"token": pa.array(list(ranks), pa.binary()), "id": pa.array(list(ranks.values()), pa.int32())})

    def load(self, name: str, columns: dict) -> None:
        self.db.register("_given", pa.table(columns))
        self.db.execute(f"create or replace temp table {name} as select * from _given")
        self.db.unregister("_given")

    def encode(self, texts: list[bytes]) -> pa.Table:
        """(piece, pos, tok) of different non-empty pieces, ordered."""
        self.load("given", {"piece": pa.array(range(len(texts)), pa.int32()), "bytes": pa.array(texts, pa.binary())})
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.load("all_bytes", {"piece": np.repeat(np.arange(len(texts), dtype=np.int32), lengths),
                                "pos": (np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32), "tok": self.bytes_id[flat]})
        # a piece that is a token as a whole needs no merges
        self.db.execute("create or replace temp table done as select g.piece, 0 as pos, v.id as tok from given g join vocabulary v on v.token = g.bytes")
        self.db.execute("create or replace temp table start as select * from all_bytes b where not exists (select 1 from done d where d.piece = b.piece)")
        while True:
            self.db.execute(f"create or replace temp table last as {RECURSION.format(rounds=ROUNDS)}")
            self.db.execute(f"insert into done select piece, pos, tok from last where it < {ROUNDS}")
            if not self.db.execute(f"select count(*) from last where it = {ROUNDS}").fetchone()[0]:
                break
            self.db.execute(f"create or replace temp table start as select piece, pos, tok from last where it = {ROUNDS}")
        self.db.execute("create or replace temp table tokens as select piece, row_number() over (partition by piece order by pos) - 1 as pos, tok from done")
        return self.db.sql("select piece, pos::int as pos, tok from tokens order by piece, pos").to_arrow_table()

    def decode(self) -> list[bytes]:
        """Bytes of the pieces encoded last, from their token ids alone."""
        found = self.db.execute("""select t.piece, list(v.token order by t.pos) as parts from tokens t join vocabulary v on v.id = t.tok group by t.piece order by t.piece""").fetchall()
        return [b"".join(parts) for _, parts in found]


def codec_of(content: bytes) -> tuple[Codec, PieceTable]:
    """One codec and piece table for each vocabulary in a worker."""
    kept = worker_state()
    key = ("bpe", hashlib.sha256(content).hexdigest())
    if key not in kept:
        kept[key] = (Codec(content), PieceTable(1_500_000))
    return kept[key]


def known_pieces(codec: Codec, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Columns of the piece table: token ids, and the bytes they decode to."""
    tokens = codec.encode([t.encode() for t in texts])
    count = np.bincount(tokens.column("piece").to_numpy(), minlength=len(texts))
    decoded = codec.decode()
    return [(count, tokens.column("tok").to_numpy().astype(np.int32)), (np.array([len(b) for b in decoded], dtype=np.int64), np.frombuffer(b"".join(decoded), np.uint8))]


def encode_texts(texts: pa.Array, content: bytes) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """(row, token ids, decoded bytes) of every text, null ones as empty."""
    codec, table = codec_of(content)
    for a, b, points, offsets in slices_of_points(texts, SLICE):
        keys, starts, ends, rows = pieces(points, offsets, spaces_join=True, single_numbers=False)
        at = table.places(keys, lambda new: known_pieces(codec, piece_texts(points, starts[new], ends[new])))
        first = np.searchsorted(rows, np.arange(b - a + 1))
        counts, ids = table.take(0, at)
        sizes, raw = table.take(1, at)
        id_at, byte_at = (np.concatenate([[0], np.cumsum(x)])[first] for x in (counts, sizes))
        for i in range(b - a):
            yield a + i, ids[id_at[i]: id_at[i + 1]], raw[byte_at[i]: byte_at[i + 1]].tobytes()


def tokens_of(docs: DataFrame, id: str, text: str, content: bytes) -> DataFrame:
    """(id, tokens): token ids of every whole text as the tiktoken library gives them without special tokens.

    ``content`` is a rank file, which travels with the tasks. Null texts are empty and give no tokens; repeated rows stay
    rows of their own; other columns are not read.
    """
    def run(batches):
        for batch in batches:
            ids = [x for _, x, _ in encode_texts(batch.column("text"), content)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["id", "tokens"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, tokens array<int>")


def digests_of(docs: DataFrame, id: str, text: str, content: bytes) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as ``tokens_of``, each text's ids and what they decode to as digests."""
    def run(batches):
        # the decimal form of every id after a comma, end to end
        forms = [b",%d" % i for i in range(max(read_ranks(content).values()) + 1)]
        width = np.array([len(f) for f in forms])
        flat, first = np.frombuffer(b"".join(forms), np.uint8), np.concatenate([[0], np.cumsum(width)])[:-1]
        for batch in batches:
            out: list[list] = [[], [], []]
            for _, ids, raw in encode_texts(batch.column("text"), content):
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(gather(flat, first[ids], width[ids])[1:].tobytes()).hexdigest())
                out[2].append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())],
                                             ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
