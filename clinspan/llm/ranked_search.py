"""Ranked lexical search: the best documents of each query by integer term weights, documents spread over the cluster.

Documents are read and cut into terms once. What is kept of each is its number and the terms that some query has, so the
second pass reads numbers only. It runs in segments of documents: a segment's postings are sorted by term, and every query
is answered over it by hybrid evaluation. Lists that are short in the segment are read whole and added up (term at a time);
their sums are one more list with a bound. That list and the long ones are then walked together in order of documents, block
by block: blocks whose largest possible sum stays below the query's tenth score are skipped, lists that can't reach it
together only confirm documents that others bring, and a document is dropped once the lists left can't lift it high enough.
Scores and ties are exact: only what is strictly below the threshold is passed over.

A task keeps the best of each query, no more; those of all tasks meet in one window per query. Queries come in blocks of
bounded size; each block is one pass over all documents.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import EMPTY, cut, fresh_dir, id_and_text, read_table, utf8

#: What a term is, in UTF-8 bytes after folding A-Z, and the numbers of the score.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
TERM_IN_TEXT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
K_TF, K_M, SCALE, FLAT, SLOPE = 1000, 8, 1_000_000_000, 10, 90
#: Pairs of query and term that one pass may hold; documents and postings of a segment; documents of a block.
BLOCK_PAIRS, SEGMENT_DOCS, SEGMENT_POSTINGS, BLOCK_DOCS = 500_000, 65_536, 4_000_000, 2_048
#: A list is short if it has at most this share of a segment's documents.
SHORT_SHARE = 1 / 64
NO_ID = (1 << 63) - 1


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, term: the distinct terms of each item, those of all rows of its id."""
    text = F.translate(F.coalesce(queries[text_col].cast("string"), F.lit(EMPTY)), UPPER, LOWER)
    return queries.select(queries[id_col].cast("long").alias("item_id"), F.explode(F.regexp_extract_all(text, F.lit(TERM_IN_TEXT), F.lit(0))).alias("term")).distinct()


def postings_of(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), terms (numbers of those that queries have), tfs of each row."""
    found = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches):
        known = found.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                words = TERM.findall(utf8(text).translate(FOLD))
                counts = [(known[w], c) for w, c in Counter(words).items() if w in known]
                n.append(len(words))
                terms.append([t for t, _ in counts])
                tfs.append([c for _, c in counts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Segment:
    """Postings of some documents, sorted by term: for each term its documents (ascending) and what it adds to them."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        owner = np.repeat(np.arange(len(ids), dtype="int64"), sizes)
        lengths = FLAT + (SLOPE * n * n_docs) // max(1, n_terms)
        adds = weights[terms] * ((SCALE * tfs) // (K_TF * tfs + K_M * lengths[owner]))
        order = np.argsort(terms, kind="stable")
        self.docs, self.adds = owner[order], adds[order]
        self.terms, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(order))
        self.most = np.maximum.reduceat(self.adds, self.first) if len(order) else self.adds

    def lists(self, wanted: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """documents, additions, largest addition of each of these terms that the segment has and that adds anything."""
        if not len(self.terms):
            return []
        at = np.searchsorted(self.terms, wanted)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == wanted)]
        return [(self.docs[self.first[i] : self.last[i]], self.adds[self.first[i] : self.last[i]], int(self.most[i])) for i in at if self.most[i] > 0]


class Best:
    """The highest k of (score, document's id, ascending), a heap whose first is the one to beat."""

    def __init__(self, k: int):
        self.k, self.heap = k, []

    def threshold(self) -> int:
        """Documents below this score can't get in."""
        return self.heap[0][0] if len(self.heap) == self.k else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        for score, doc_id in zip(scores.tolist(), ids.tolist(), strict=True):
            entry = (score, -doc_id)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


def summed(lists: list) -> tuple[np.ndarray, np.ndarray, int]:
    """Short lists as one: documents, their sums, the largest sum."""
    docs = np.concatenate([d for d, _, _ in lists])
    order = np.argsort(docs, kind="stable")
    docs, adds = docs[order], np.concatenate([a for _, a, _ in lists])[order]
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    sums = np.add.reduceat(adds, first)
    return docs[first], sums, int(sums.max())


def search(segment: Segment, wanted: np.ndarray, best: Best, short_share: float = SHORT_SHARE, block_docs: int = BLOCK_DOCS) -> None:
    """Offers best the documents of the segment that may be among the highest for these terms."""
    lists = segment.lists(wanted)
    if not lists:
        return
    limit = max(1, int(len(segment.ids) * short_share))
    short, rows = [x for x in lists if len(x[0]) <= limit], [x for x in lists if len(x[0]) > limit]
    if short:
        rows.append(summed(short))
    if sum(x[2] for x in rows) < best.threshold():
        return
    rows.sort(key=lambda x: x[2])
    borders = np.arange(0, len(segment.ids) + block_docs, block_docs)
    cuts = [np.searchsorted(docs, borders) for docs, _, _ in rows]
    for b in range(len(borders) - 1):
        parts = []
        for (docs, adds, _), at in zip(rows, cuts, strict=True):
            lo, hi = at[b], at[b + 1]
            if lo < hi:
                mine = adds[lo:hi]
                parts.append((docs[lo:hi], mine, int(mine.max())))
        floor = best.threshold()
        if sum(x[2] for x in parts) < floor:
            continue
        parts.sort(key=lambda x: x[2])
        # Lists from the lowest bound up that don't reach the threshold together bring no documents of their own.
        reach, driven = 0, 0
        while driven < len(parts) and reach + parts[driven][2] < floor:
            reach += parts[driven][2]
            driven += 1
        base = b * block_docs
        sums = np.zeros(block_docs, dtype="int64")
        for docs, adds, _ in parts[driven:]:
            sums[docs - base] += adds  # a document stands once in a list
        found = np.flatnonzero((sums > 0) & (sums + reach >= floor))
        scores = sums[found]
        for docs, adds, most in reversed(parts[:driven]):
            if not len(found):
                break
            at = np.minimum(np.searchsorted(docs, found + base), len(docs) - 1)
            scores = scores + np.where(docs[at] == found + base, adds[at], 0)
            reach -= most
            alive = scores + reach >= floor
            found, scores = found[alive], scores[alive]
        if len(found) > best.k:  # all of the block that tie with the k-th stay, ids decide
            kth = np.partition(scores, len(scores) - best.k)[len(scores) - best.k]
            found, scores = found[scores >= kth], scores[scores >= kth]
        if len(found):
            best.offer(scores, segment.ids[found + base])


def best_of_tasks(postings: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (its place in items), doc_id, score: the best k of each task. A null id stands as the largest number, so that it comes last among equals."""
    shared = postings.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = shared.value
        best = [Best(k) for _ in items]
        held, n_held, postings_held = [], 0, 0

        def answer():
            ids, n, sizes, terms, tfs = (np.concatenate(c) for c in zip(*held, strict=True))
            segment = Segment(ids, n, sizes, terms, tfs, weights, n_docs, n_terms)
            for wanted, own in zip(items, best, strict=True):
                search(segment, wanted, own)

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            lists, tfs = batch.column(2), batch.column(3)
            offsets = lists.offsets.to_numpy()
            terms, counts = lists.flatten().to_numpy(), tfs.flatten().to_numpy()
            at = 0
            while at < len(ids):  # a batch may be larger than a segment
                end = min(len(ids), at + SEGMENT_DOCS)
                if offsets[end] - offsets[at] > SEGMENT_POSTINGS:
                    end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT_POSTINGS, side="right")) - 1)
                lo, hi = offsets[at] - offsets[0], offsets[end] - offsets[0]
                if held and (n_held + end - at > SEGMENT_DOCS or postings_held + hi - lo > SEGMENT_POSTINGS):
                    answer()
                    held, n_held, postings_held = [], 0, 0
                held.append((ids[at:end], batch.column(1).to_numpy()[at:end], np.diff(offsets[at : end + 1]).astype("int64"), terms[lo:hi], counts[lo:hi]))
                n_held, postings_held, at = n_held + end - at, postings_held + hi - lo, end
        if held:
            answer()
        out = [(i, doc_id, score) for i, own in enumerate(best) for score, doc_id in own.heap]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        ids = [None if -x == NO_ID else -x for x in columns[1]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(ids, pa.int64()), pa.array(columns[2], pa.int64())], names=["item", "doc_id", "score"])

    return postings.mapInArrow(run, "item int, doc_id long, score long")


def ranked_documents(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: of each item the k documents of the highest score above 0, equal scores by
    ascending doc_id.

    Null and empty texts have no terms; items without terms, or without a document, have no rows; rows of one item_id are one
    item with the terms of all of them, a null item_id is one too. Repeated rows of docs rank one after the other, those
    without an id after those that have one; an empty table gives an empty result; other columns are ignored, whatever their
    names. The driver holds one block of items at a time: block_pairs pairs of item and term, unless a single item has more.
    """
    spark = docs.sparkSession
    pairs = cut(query_terms(queries, item_col, query_col))
    blocks = max(1, -(-pairs.count() // block_pairs))
    pairs = pairs.withColumn("block", F.pmod(F.xxhash64(F.coalesce("item_id", F.lit(0)), F.col("item_id").isNull()), F.lit(blocks)))
    texts, parts = id_and_text(docs, id_col, text_col), []
    for b in range(blocks):
        rows = pairs.where(F.col("block") == b).select("item_id", "term").collect()
        if not rows:
            continue
        number = {t: i for i, t in enumerate(sorted({utf8(r["term"]) for r in rows}))}
        by_item: dict = {}
        for r in rows:
            by_item.setdefault(r["item_id"], []).append(number[utf8(r["term"])])
        names = sorted(by_item, key=lambda i: (i is None, i or 0))
        folder = fresh_dir(spark, "postings")
        postings_of(texts, number).where("n > 0").write.parquet(folder)
        postings = spark.read.schema("doc_id long, n long, terms array<int>, tfs array<long>").parquet(folder)
        n_docs, n_terms = postings.agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.zeros(len(number), dtype="int64")
        for term, df in postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the block's terms at most
            weights[term] = weight(n_docs, df)
        items = [np.array(sorted(by_item[i]), dtype="int64") for i in names]
        found = best_of_tasks(postings.where(F.size("terms") > 0), items, weights, n_docs, n_terms, k)
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        keys = spark.createDataFrame([(i, x) for i, x in enumerate(names)], "item int, item_id long")
        parts.append(cut(ranked.join(keys, "item").select("item_id", "rank", "doc_id", "score")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = f"unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_IN_TEXT}'))"
SQL = f"""
WITH numbered AS (SELECT row_number() OVER () AS i, doc_id, text FROM documents),
words AS (SELECT i, {_TERMS} AS term FROM numbered),
sizes AS (SELECT i, count(*) AS n FROM words GROUP BY 1),
facts AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sizes),
asked AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, {_TERMS} AS term FROM benchmark)),
tfs AS (SELECT i, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY 1), facts),
parts AS (SELECT i, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))) AS part FROM tfs JOIN sizes USING (i) JOIN weights USING (term), facts),
scores AS (SELECT item_id, i, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY 1, 2 HAVING sum(part) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scores JOIN numbered USING (i)
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 10
"""
