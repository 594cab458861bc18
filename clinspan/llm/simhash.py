"""SimHash near-duplicates by bit-sliced comparison.

1. Each text becomes a 64-bit fingerprint over its word shingles; equal fingerprints are grouped, so a group of copies of
   any size is one row from there on.
2. Candidates: fingerprints within ``radius`` bits agree on at least ``bands - radius`` of ``bands`` bands, so each is
   dealt out once for every choice of so many bands (pigeonhole principle: no pair is missed).
3. Inside a bucket, fingerprints stand in blocks of 64 as bit planes: plane b holds bit b of 64 fingerprints in one word.
   One word operation updates 64 distances, kept as carry-save counters of 2 bits with a flag for overflow. A (query,
   block) item is given up as soon as all its 64 lanes exceed the radius. Buckets above ``split_rows`` are cut in pieces
   whose pairs are compared in tasks of their own, so no bucket has to fit one task.
4. A bucket gives a spanning forest of its links, not its pairs; connected components are found by joining edges with
   the smallest neighbour until nothing changes, each round written to the shared checkpoint folder.
"""

from __future__ import annotations

import math
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import EMPTY, HOT_ROWS, cut, id_and_text, join_copies, read_table, utf8

BITS = 64
#: (query, block) items that are compared at once; 64 lanes each.
ITEMS = 1 << 16
#: A bucket with more fingerprints is cut in pieces of about this many.
SPLIT_ROWS = 100_000
#: Subtracted from a wanted similarity of texts: half the deviation of its estimate. For estimates alone; links of
#: ``similar_documents`` are candidates within ``safe_radius``, decided by their sets.
SLACK = 0.02
#: Deviations of the distance of two SimHashes that ``safe_radius`` allows for.
DEVIATIONS = 5
#: The largest component of candidates whose sets are compared as one group.
WHOLE = 64
#: Shingles for each row of split_rows in a piece of sets, and bytes of rows that are held at once.
SPLIT_SHINGLES, HELD_BYTES = 40, 128 << 20


def text_fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Bit b is 1 if it is set in over half the shingles' XXH64 (UTF-8), repeats counted; no word: 0."""
    tokens = utf8(text).lower().split()  # bytes: ASCII letters and ASCII white space only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    hash_ = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return hash_(joined, seed)
    ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
    starts = [0, *ends[: -words]]
    hashes = np.array([hash_(joined[a : b - 1], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 8192):
        counts += np.unpackbits(hashes[at : at + 8192, None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long). Null and empty texts have fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([text_fingerprint(t, words, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def band_key(fp: Column, chosen: tuple[int, ...], bands: int) -> Column:
    """The bits of the chosen bands, side by side; other bits are 0."""
    edges = [BITS * i // bands for i in range(bands + 1)]
    mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(bits, blocks) of fingerprints of one or more words: plane b, word j: bit b of fingerprints 64 j to 64 j + 63, the
    first in the lowest bit."""
    blocks = -(-len(fps) // BITS)
    padded = np.zeros((blocks * BITS, fps.shape[1]), dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")  # (rows, bits)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def _above(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counters (lowest bit first) are above radius: a comparison bit by bit, 64 lanes at a time."""
    above = np.zeros_like(counters[0])
    equal = ~above
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above


def close_lanes(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, block: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For items (query row, block), the lanes (among ``lanes``) at most radius bits away: positions of items that have
    any, and their lanes. Items whose lanes all exceed the radius are given up on the way."""
    item = np.arange(len(query))
    counters = [np.zeros(len(query), dtype=np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(len(query), dtype=np.uint64)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    step = 4 if radius < 8 else 16
    for b in range(len(planes)):
        wanted = fps[query, b // BITS] >> np.uint64(b % BITS) & np.uint64(1)
        carry = planes[b, block] ^ np.where(wanted, full, np.uint64(0))
        for k, c in enumerate(counters):  # adds one bit to each lane's number
            counters[k], carry = c ^ carry, c & carry
        over |= carry
        if b % step == step - 1 and b < len(planes) - 1:
            alive = (lanes & ~(over | _above(counters, radius))) != 0
            if not alive.all():
                item, query, block, lanes, over, *counters = (x[alive] for x in (item, query, block, lanes, over, *counters))
                if not len(item):
                    break
    near = lanes & ~(over | _above(counters, radius))
    hit = near != 0
    return item[hit], near[hit]


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins a[i] and b[i]; every row points to the smallest row of its set."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return parent
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


class _Sets:
    """Sets of hashes, one per row, given as their bytes."""

    def __init__(self, parts: list[bytes], similarity: float):
        self.similarity = similarity
        self.size = np.array([len(p) // 8 for p in parts])
        self.first = np.cumsum(self.size) - self.size
        distinct, ids = np.unique(np.frombuffer(b"".join(parts), dtype="<u8"), return_inverse=True)
        self.ids, self.mine = ids.reshape(-1), np.zeros(len(distinct), dtype=bool)

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether rows a[i] and b[i] have at least the similarity (Jaccard, exact); a is sorted."""
        out = np.minimum(self.size[a], self.size[b]) / np.maximum(self.size[a], self.size[b]) >= self.similarity
        at = np.flatnonzero(out)
        for run in np.split(at, np.flatnonzero(np.diff(a[at])) + 1) if len(at) else ():
            row, others = a[run[0]], b[run]
            own = self.ids[self.first[row] : self.first[row] + self.size[row]]
            self.mine[own] = True
            size = self.size[others]
            starts = np.cumsum(size) - size
            theirs = self.ids[np.repeat(self.first[others] - starts, size) + np.arange(int(size.sum()))]
            common = np.add.reduceat(self.mine[theirs].astype(np.int64), starts)
            self.mine[own] = False
            out[run] = common / (len(own) + size - common) >= self.similarity
        return out


def linked(fps: np.ndarray, first: np.ndarray, end: np.ndarray, radius: int, sets: _Sets | None = None) -> np.ndarray:
    """Row -> smallest row that it is linked to, directly or by others. Row i is compared with rows first[i] to end[i] - 1;
    with sets, rows within the radius are linked only if their sets are similar, which is asked of rows not yet linked."""
    planes, parent = bit_planes(fps), np.arange(len(fps))
    spans = np.where(end > first, (end - 1) // BITS - first // BITS + 1, 0)
    upto = np.cumsum(spans)
    row = 0
    while row < len(fps):
        stop = max(row + 1, int(np.searchsorted(upto, (upto[row - 1] if row else 0) + ITEMS, side="right")))
        count = spans[row:stop]
        query = np.repeat(np.arange(row, stop), count)
        if len(query):
            step = np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
            block = first[query] // BITS + step
            low = np.clip(first[query] - block * BITS, 0, BITS - 1).astype(np.uint64)
            high = np.clip(end[query] - block * BITS, 1, BITS).astype(np.uint64)
            full = np.uint64(0xFFFFFFFFFFFFFFFF)
            lanes = (full << low) & (full >> (np.uint64(BITS) - high))
            item, near = close_lanes(planes, fps, query, block, lanes, radius)
            for at in range(0, len(item), 4096):
                part = near[at : at + 4096]
                which, lane = np.nonzero(np.unpackbits(part.astype("<u8")[:, None].view(np.uint8), axis=1, bitorder="little"))
                chosen = item[at : at + 4096][which]
                a, b = query[chosen], block[chosen] * BITS + lane
                while sets is not None and len(a):
                    apart = parent[a] != parent[b]
                    a, b = a[apart], b[apart]
                    right = sets.similar(a[:2048], b[:2048])
                    parent = _roots(parent, a[:2048][right], b[:2048][right])
                    a, b = a[2048:], b[2048:]
                parent = _roots(parent, a, b)
        row = stop
    return parent


def _bucket_links(radius: int, similarity: float | None = None, named: bool = False):
    """Sorted (choice, key, piece_a, piece_b, side, node, fp) rows, with a similarity also hashes -> links (a, b) of nodes
    that span each bucket; named: with the bucket's four columns."""

    def links(node: np.ndarray, fps: np.ndarray, starts: np.ndarray, side: np.ndarray, sets: _Sets | None, buckets: list[np.ndarray]) -> pa.RecordBatch | None:
        size = np.diff(np.append(starts, len(fps)))
        end = np.repeat(starts + size, size)
        # In a bucket of two pieces (side 0, then side 1) rows of the first meet those of the second only.
        split = np.add.reduceat(side == 0, starts)
        two = np.repeat(split < size, size)
        first = np.where(two, np.repeat(starts + split, size), np.arange(len(fps)) + 1)
        end = np.where(two & (side == 1), first, end)
        parent = linked(fps, first, end, radius, sets)
        moved = np.flatnonzero(parent != np.arange(len(fps)))
        if not len(moved):
            return None
        own = [pa.array(c[moved]) for c in buckets] if named else []
        return pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[parent[moved]]), *own], names=["a", "b", *("choice", "key", "piece_a", "piece_b")[: len(own)]])

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = size = 0

        def flush(keep_last: bool):
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(i).to_numpy() for i in range(4)]
            new = np.ones(table.num_rows, dtype=bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            starts = np.flatnonzero(new)
            whole = starts[-1] if keep_last else table.num_rows
            done = None
            if whole:
                mine = starts[starts < whole]
                several = np.repeat(np.diff(np.append(mine, whole)) > 1, np.diff(np.append(mine, whole)))
                if several.any():
                    node, side = (table.column(i).to_numpy()[:whole][several] for i in (5, 4))
                    parts = table.column(6).slice(0, whole).filter(pa.array(several)).to_pylist()
                    fps = np.frombuffer(b"".join(parts), dtype="<u8").reshape(len(parts), -1)
                    sets = None if similarity is None else _Sets(table.column(7).slice(0, whole).filter(pa.array(several)).to_pylist(), similarity)
                    done = links(node, fps, np.flatnonzero(new[:whole][several]), side, sets, [k[:whole][several] for k in keys])
            return done, table.slice(whole).to_batches()

        for batch in batches:
            held.append(batch)
            rows, size = rows + batch.num_rows, size + batch.nbytes
            if rows >= 4 * SPLIT_ROWS or size >= HELD_BYTES:
                done, held = flush(True)
                rows, size = sum(x.num_rows for x in held), 0
                if done:
                    yield done
        if held and rows:
            done, _ = flush(False)
            if done:
                yield done

    return run


def linked_in_buckets(keyed: DataFrame, radius: int, split_rows: int = SPLIT_ROWS, similarity: float | None = None, name_trees: bool = False) -> DataFrame:
    """Links (a, b) of nodes that connect, within each bucket (choice, key), all fingerprints at most radius bits apart.
    keyed: choice, key, node (long), fp (binary, whole 64-bit words). With a similarity, only those whose sets have it;
    keyed has them as hashes (binary), and buckets are cut by the numbers of hashes. name_trees: also tree, a number of the
    bucket (or pair of its pieces) and b: all that it found connected to b there."""
    spark = keyed.sparkSession
    carried = ["node", "fp"] if similarity is None else ["node", "fp", "hashes"]
    weight = F.count(F.lit(1)) if similarity is None else F.ceil(F.sum(F.octet_length("hashes")) / (8 * SPLIT_SHINGLES))
    large = cut(keyed.groupBy("choice", "key").agg(weight.alias("count")).where(F.col("count") > split_rows).withColumn("pieces", F.ceil(F.col("count") / split_rows).cast("int")).select("choice", "key", "pieces"))
    plain = [F.lit(0).alias("piece_a"), F.lit(0).alias("piece_b"), F.lit(0).alias("side")]
    if large.isEmpty():
        dealt = keyed.select("choice", "key", *plain, *carried)
    else:
        some = keyed.join(large, ["choice", "key"])
        piece = F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda o: F.struct(F.least(o, F.col("piece")).alias("piece_a"), F.greatest(o, F.col("piece")).alias("piece_b"), (F.col("piece") > o).cast("int").alias("side")))
        cut_up = some.withColumn("piece", piece).select("choice", "key", F.explode(pairs).alias("p"), *carried).select("choice", "key", "p.piece_a", "p.piece_b", "p.side", *carried)
        dealt = keyed.join(large, ["choice", "key"], "left_anti").select("choice", "key", *plain, *carried).unionByName(cut_up)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["choice", "key", "piece_a", "piece_b", "side", "node"]
    sorted_ = dealt.repartition(parts, *order[:4]).sortWithinPartitions(*order).select(*order, *carried[1:])
    if not name_trees:
        return sorted_.mapInArrow(_bucket_links(radius, similarity), "a long, b long").distinct()
    found = sorted_.mapInArrow(_bucket_links(radius, similarity, named=True), "a long, b long, choice int, key long, piece_a int, piece_b int")
    return found.select(F.xxhash64("choice", "key", "piece_a", "piece_b", "b").alias("tree"), "a", "b")


def near_links(distinct: DataFrame, radius: int = 3, bands: int = 5, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp (long) that connect all within radius bits of each other."""
    if radius < 0 or bands <= radius:
        raise ValueError("more bands than bits of radius")
    choices = list(combinations(range(bands), bands - radius))
    word = F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("fp")  # its eight bytes, whose order is of no matter here
    keyed = distinct.select(F.col("fp").alias("node"), word, F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), band_key(F.col("fp"), c, bands).alias("key")) for i, c in enumerate(choices)))).alias("k"))
    return linked_in_buckets(keyed.select("k.choice", "k.key", "node", "fp"), radius, split_rows)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of the links (a, b) reaches, by alternating large- and small-star
    rounds. The number of rounds follows the logarithm of the longest path. A round joins edges with the smallest neighbour of
    each node: at the hub of a large component many edges have one key; the side of one row a node is what Spark copies when
    it splits such a partition of the join (adaptive execution, skewed joins), and groupings sum before the shuffle."""
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u")
        small = kept.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = cut(small)
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3, bands: int = 5, split_rows: int = SPLIT_ROWS, hot_rows: int = HOT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row per row of docs.

    Fingerprints at most radius bits apart are linked; component_id is the smallest doc_id that a document reaches over
    links, itself included. Null and empty texts, and texts of white space, have fingerprint zero and are linked like any
    other; rows without an id are kept and take their component's smallest id (null if it has none); repeated rows come
    out each; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    rows = cut(fingerprints(docs, words, seed, id_col, text_col))
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    found = components(near_links(distinct.select("fp"), radius, bands, split_rows)).select(F.col("node").alias("fp"), "root")
    rooted = distinct.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = cut(rooted.join(smallest, "root").select("fp", "component_id", "copies"))
    return join_copies(rows, named, "fp", hot_rows=hot_rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Similarity of texts: wide fingerprints compared inside buckets of equal smallest hashes.


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The set of word shingles as their sorted XXH64; a text of fewer words is one shingle."""
    tokens = utf8(text).lower().split()
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        shingles = [xxhash.xxh64_intdigest(joined)]
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens]).tolist()
        shingles = {xxhash.xxh64_intdigest(joined[a : b - 1]) for a, b in zip([0, *ends[:-words]], ends[words - 1 :], strict=True)}
    return np.array(sorted(shingles), dtype="<u8")


def set_number(hashes: np.ndarray) -> int:
    """A number of the whole set, as a signed long."""
    found = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return found - (1 << 64) if found >> 63 else found


def wide_signature(text: str, words: int, n_words64: int, keys: int, per_key: int) -> tuple[bytes, list[int]]:
    """(SimHash of n_words64 * 64 bits over the set of word shingles, keys: each from per_key smallest hashes).

    Two sets of Jaccard similarity s share a key with probability s ** per_key, independently per key.
    """
    return signature_of(shingle_hashes(text, words), n_words64, keys, per_key)


def signature_of(hashes: np.ndarray, n_words64: int, keys: int, per_key: int) -> tuple[bytes, list[int]]:
    """``wide_signature`` of a set of shingles' hashes."""
    salts = _mixed(np.arange(1, max(n_words64, keys * per_key) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    counts = np.zeros(n_words64 * BITS, dtype=np.int64)
    least = np.full(keys * per_key, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), 2048):
        part = hashes[at : at + 2048, None]
        bits = np.unpackbits(np.ascontiguousarray(_mixed(part ^ salts[:n_words64])).view(np.uint8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        least = np.minimum(least, (part * (salts[: keys * per_key] | np.uint64(1))).min(axis=0))
    signature = np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes()
    rows = least.reshape(keys, per_key)
    mixed = rows[:, 0]
    for k in range(1, per_key):
        mixed = _mixed(mixed) ^ rows[:, k]
    return signature, mixed.view(np.int64).tolist()


def radius_of(similarity: float, bits: int) -> int:
    """The number of bits in which SimHashes of two sets of equal size and this Jaccard similarity differ, on average."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _differing(common: int, a: int, b: int) -> float:
    """The chance that a bit differs in the SimHashes of two sets of so many common shingles and a and b of their own."""
    above = lambda k, n: sum(math.comb(n, x) for x in range(n + 1) if 2 * (k + x) > common + n) / 2**n
    chances = ((math.comb(common, k) / 2**common, above(k, a), above(k, b)) for k in range(common + 1))
    return sum(w * (p * (1 - q) + q * (1 - p)) for w, p, q in chances)


@cache
def safe_radius(similarity: float, bits: int) -> int:
    """A number of bits in which SimHashes of two sets of at least this Jaccard similarity differ at most: DEVIATIONS above
    the average of the worst sizes. Those are small sets, where ties count as 0 (four shingles inside five at 0.8)."""
    share = radius_of(similarity, bits) / bits
    for own in range(1, 13) if similarity < 1 else ():
        least = math.ceil(similarity * own / (1 - similarity) - 1e-9)
        share = max(share, *(_differing(c, a, own - a) for c in range(least, min(least + 2, 64)) for a in range(own // 2 + 1)), 0)
    return min(bits, math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share))))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 512, keys: int = 16, per_key: int = 3, split_rows: int = SPLIT_ROWS, hot_rows: int = HOT_ROWS, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE) -> DataFrame:
    """doc_id, component_id: documents linked where their sets of word shingles have at least this Jaccard similarity.

    Candidates are ``bits``-bit SimHashes within ``safe_radius``, compared as bit planes among texts that share one of
    ``keys`` keys of ``per_key`` smallest hashes: a pair of similarity 0.8 shares none with probability
    (1 - 0.8 ** 3) ** 16, about 1 in 100,000. The sets of texts that have a candidate then decide: where candidates met in a
    bucket (or anywhere in a small component of them), those in the radius are linked if their exact similarity suffices. Equal sets are one node, however many
    documents have them. Only rows with an id; null and empty texts are alike; repeated rows come out each. Rows of one id
    with different texts are documents of their own.
    """
    rows, named = rooted(docs, words, similarity, bits, keys, per_key, split_rows, id_col, text_col, whole)
    return join_copies(rows, named, "node", hot_rows=hot_rows).select("doc_id", "component_id")


def text_hash(docs: DataFrame, text_col: str = "text") -> Column:
    """Tells apart the texts of an id that repeats; null texts as empty ones."""
    return F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(EMPTY)))


def compared_in(links: DataFrame, whole: int) -> DataFrame:
    """node, places: the groups in which a node's set meets others, so that every two of a candidate pair meet in one.

    links: tree, a, b of ``linked_in_buckets``: a tree is all that a bucket found connected, so it holds each of the bucket's
    candidate pairs as a whole. A component of at most ``whole`` nodes is one group: its nodes meet that many others at most.
    In larger ones, as chains of pages that share their boilerplate, groups are the trees themselves, so that a node meets
    those of its buckets only, however long the chain is; trees of the same nodes are one."""
    links = cut(links)
    found = cut(components(links))
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    sized = found.join(sizes, "root")
    small = sized.where(F.col("n") <= whole).select("node", F.array("root").alias("places"))
    large = sized.where(F.col("n") > whole).select("node")
    members = links.select("tree", F.col("a").alias("node")).unionByName(links.select("tree", F.col("b").alias("node")).distinct())
    members = cut(members.join(large, "node", "left_semi"))
    same = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
    trees = members.groupBy("tree").agg(*same).groupBy("n", "x", "y").agg(F.min("tree").alias("tree"))
    return small.unionByName(members.join(trees, "tree", "left_semi").groupBy("node").agg(F.collect_list("tree").alias("places")))


def rooted(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 512, keys: int = 16, per_key: int = 3, split_rows: int = SPLIT_ROWS, id_col: str = "doc_id", text_col: str = "text", whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """``similar_documents`` as (doc_id, text_hash, node of each row) and (node, first_id, root, component_id, copies of each
    node): root names the component, also where two of them have the same smallest id."""

    def run(batches):
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch.column(1).to_pylist()]
            found = [signature_of(h, bits // BITS, keys, per_key) for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([set_number(h) for h in sets], pa.int64()), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "fp", "keys"])

    def sets_of(batches):
        for batch in batches:
            sets = [shingle_hashes(t, words) for t in batch.column(3).to_pylist()]
            own = pa.array([set_number(h) == n for h, n in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())  # an id may repeat with other texts
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([h.tobytes() for h in sets], pa.binary())], names=["places", "node", "fp", "hashes"]).filter(own)

    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    rows = cut(texts.withColumn("text_hash", text_hash(texts)).mapInArrow(run, "doc_id long, text_hash long, node long, fp binary, keys array<long>"))
    nodes = rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    keyed = nodes.select("node", "fp", F.posexplode("keys").alias("choice", "key")).select("choice", "key", "node", "fp")
    radius = safe_radius(similarity, bits)
    where = compared_in(linked_in_buckets(keyed, radius, split_rows, name_trees=True), whole)
    # One row for each node before the join, so that copies of one text stay out of it.
    firsts = rows.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("fp").alias("fp")).join(where, "node")
    asked = texts.join(firsts, "doc_id").select("doc_id", "places", "node", "fp", "text").distinct()
    sets = cut(asked.select("places", "node", "fp", "text").mapInArrow(sets_of, "places array<long>, node long, fp binary, hashes binary"))
    placed = sets.select(F.lit(0).alias("choice"), F.explode("places").alias("key"), "node", "fp", "hashes")
    links = linked_in_buckets(placed, radius, split_rows, similarity)
    each = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    named = each.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "text_hash", "node"), cut(named.join(smallest, "root").select("node", "first_id", "root", "component_id", "copies"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs, all columns, with one row of each group of ``similar_documents``: the one of the smallest id, the first of its
    rows in the group (by all columns) if the id repeats. Rows without an id stay, since no id could name them as a copy."""
    nodes, named = rooted(docs, id_col=id_col, text_col=text_col, **settings)
    # Joined by id and node, a key that copies of one text don't share.
    firsts = named.where("first_id = component_id").select(F.col("first_id").alias("doc_id"), "node", "root")
    kept = nodes.join(firsts, ["doc_id", "node"]).groupBy("doc_id", "text_hash", "root").count()
    kept = cut(kept.withColumn("count", F.sum("count").over(Window.partitionBy("root"))).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash", "root": "_root"}))
    named = docs.withColumns({"_id": docs[id_col].cast("long"), "_hash": text_hash(docs, text_col)})
    single = named.join(kept.where("count = 1"), ["_id", "_hash"], "left_semi")
    repeated = kept.where("count > 1").drop("count")
    out = single.select(*docs.columns).unionByName(named.where("_id is null").select(*docs.columns))
    if repeated.isEmpty():
        return out
    rows = named.join(repeated, ["_id", "_hash"])
    firsts = rows.groupBy("_id", "_root").agg(F.min(F.struct(*docs.columns)).alias("first")).select("first.*")
    return out.unionByName(firsts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
