"""Best-fit packing, planned on the histogram of lengths.

1. Each text's ids are cut in pieces of at most ``capacity`` tokens; a piece is known by its length.
2. The driver plans on counts: at most ``capacity`` lengths, whatever the corpus. Best-fit decreasing over groups of equal
   bins gives runs: pieces of one length with ranks lo, lo + 1, ... go to consecutive sequences at one offset.
3. Pieces are ranked within their length: counts by (length, salt) give each salt's first rank, a window numbers the rows
   inside (length, salt). So a length that a third of all pieces have is ranked by as many tasks as there are salts.
4. Each piece looks its slot up by (length, rank) in the plan, whose size depends on capacity alone.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import cut, id_and_text, read_table
from .pretokens import WordLevelIds

CAPACITY = 2048
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Bins:
    """Bins with equal contents: how many, and (length, times) from the start of each."""

    __slots__ = ("content", "count")

    def __init__(self, count: int, content: tuple[tuple[int, int], ...]):
        self.count, self.content = count, content


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts. Runs (length, lo, hi, first sequence, times, offset): the piece of that length
    and rank r in lo..hi-1 goes to sequence first + (r - lo) // times, at offset + ((r - lo) % times) * length."""
    by_room: dict[int, list[_Bins]] = {}
    rooms: list[int] = []

    def put(room: int, bins: _Bins) -> None:
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append(bins)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)  # the smallest room that holds it
            room = rooms[at] if at < len(rooms) else capacity
            times = room // length
            if at < len(rooms):
                held = by_room[room]
                group = held.pop()
                if not held:
                    del by_room[room]
                    rooms.pop(at)
            else:
                group = _Bins(-(-left // times), ())
            filled = min(group.count, left // times)
            if filled:
                put(room - times * length, _Bins(filled, (*group.content, (length, times))))
                left -= filled * times
            rest = group.count - filled
            if rest and left:  # fewer than fill one more bin
                put(room - left * length, _Bins(1, (*group.content, (length, left))))
                rest, left = rest - 1, 0
            if rest:
                put(room, _Bins(rest, group.content))
    runs, first, ranks = [], 0, dict.fromkeys(counts, 0)
    for room in rooms:
        for bins in by_room[room]:
            offset = 0
            for length, times in bins.content:
                lo = ranks[length]
                ranks[length] = lo + bins.count * times
                runs.append((length, lo, ranks[length], first, times, offset))
                offset += length * times
            first += bins.count
    return sorted(runs)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each text's ids with end_id after them."""
    path = os.fspath(tokenizer_path)
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        tokens = WordLevelIds(path)
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = tokens.ids(text) + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, PIECE_SCHEMA)


def rank_within_length(pieces: DataFrame, salts: int) -> DataFrame:
    """pieces with rank, from 0 and gapless within each length, by (salt, doc_id, piece, ids_crc32, start)."""
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")
    return salted.withColumn("at", F.row_number().over(within)).join(bases, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("at") - 1).drop("at", "base", "salt")


def place(ranked: DataFrame, runs: list[tuple[int, int, int, int, int, int]]) -> DataFrame:
    """ranked pieces with sequence_id and offset, as the plan has them."""
    spark = ranked.sparkSession
    table = spark.sparkContext.broadcast(np.array(runs, dtype="int64").reshape(-1, 6))
    fields = [f.name for f in ranked.schema.fields]
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ranked.schema.fields if f.name != 'rank')}, sequence_id long, offset long"

    def run(batches):
        t = table.value
        starts = {int(n): (a, b) for n, a, b in zip(*_spans(t[:, 0]), strict=True)}
        for batch in batches:
            length = batch.column(fields.index("length")).to_numpy()
            rank = batch.column(fields.index("rank")).to_numpy()
            at = np.empty(len(length), dtype="int64")
            for n in np.unique(length):
                a, b = starts[int(n)]
                mine = length == n
                at[mine] = a + np.searchsorted(t[a:b, 1], rank[mine], side="right") - 1
            inside = rank - t[at, 1]
            sequence = t[at, 3] + inside // t[at, 4]
            offset = t[at, 5] + inside % t[at, 4] * length
            kept = [batch.column(i) for i, f in enumerate(fields) if f != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=[*(f for f in fields if f != "rank"), "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def _spans(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, first = np.unique(sorted_, return_index=True)
    return values, first, np.append(first[1:], len(sorted_))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts have the end id alone; rows without an id and repeated rows are packed like others; an empty
    table gives an empty result; other columns are ignored, whatever their names. Only texts of more than capacity ids
    are cut. Ties in length are ranked by a hash of the piece, so reruns agree.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    salts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return place(rank_within_length(pieces, salts), plan(counts, capacity))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
