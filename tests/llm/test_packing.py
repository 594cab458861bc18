import random
import struct
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from clinspan.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        i = min((i for i in range(len(rooms)) if rooms[i] >= n), key=lambda i: rooms[i], default=None)
        if i is None:
            rooms.append(capacity - n)
        else:
            rooms[i] -= n
    return len(rooms)


def check(rows, out, capacity=2048):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((doc_id, p, at, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    assert sorted(want, key=str) == sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=str)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= best_fit([w[3] for w in want], capacity)


def test_plan_is_best_fit():
    rng = random.Random(1)
    for _ in range(100):
        capacity = rng.choice([4, 10, 64])
        counts = {n: rng.randint(1, 40) for n in range(1, capacity + 1) if rng.random() < 0.6}
        bins, seen = {}, {}
        for length, lo, hi, first, times, offset in packing.plan(counts, capacity):
            for r in range(lo, hi):
                bins.setdefault(first + (r - lo) // times, []).append((offset + (r - lo) % times * length, length))
                seen[length] = seen.get(length, 0) + 1
        assert seen == counts
        for held in bins.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= best_fit([n for n, c in counts.items() for _ in range(c)], capacity)


def test_edges_of_input(spark):
    rows = [(1, None), (2, ""), (None, "The <|endoftext|> 'S don't İstanbul ŉ"), (3, "a " * 5000), (3, "a " * 5000), (4, "x" * 30000), (5, "中文 é  ½²\x85q\x1cz"), (6, "same"), (6, "same"), (7, "other")]
    docs = spark.createDataFrame([(*r, 1, 2, "r") for r in rows], "doc_id long, text string, length int, `offset` int, rank string")
    check(rows, packing.pack(docs, PATH).collect())
    small = packing.pack(docs, PATH, capacity=7).collect()
    check(rows, small, 7)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_whole_table_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, packing.query(spark, sf).collect())
