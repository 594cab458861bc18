import re

import duckdb
import pytest
from pyspark.sql import functions as F

from clinspan.llm import mixing


def reshared(sizes, weights, budget, cap=2):
    """Targets by resharing the excess until none is above."""
    target, stopped = {}, set()
    while True:
        left = budget - sum(cap * sizes[s] for s in stopped)
        w = sum(weights[s] for s in sizes if s not in stopped)
        target = {s: cap * sizes[s] if s in stopped else left * weights[s] / w for s in sizes}
        above = {s for s in sizes if s not in stopped and target[s] > cap * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        stopped |= above


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, size int, place int")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len([w for w in (text or "").encode().split()])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = reshared(sizes, weights, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, want[s] / 1000)
    return sorted(map(tuple, out), key=str)


def test_targets_and_edges_of_input(spark):
    rows = [(i, "word " * (i % 50), "abcde"[i % 5] if i % 3 else "a") for i in range(400)]
    rows += [(1000, None, "z"), (1001, "", None), (None, "a b c", None), (None, "a b c", None), (5, "x\x1cy z\x0b\x85", "é"), (1002, "t " * 90000, "long"), (7, "same", "a"), (7, "same", "a")]
    first = check(spark, rows)
    assert check(spark, rows[::-1]) == first  # however the rows stand
    check(spark, [(1, "one two three", None)])
    check(spark, [(1, None, "a"), (2, " ", "b")])
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_schedule_spreads_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 40, "abc"[i % 3]) for i in range(900)], "doc_id long, text string, source string")
    table = mixing.targets(mixing.sized(docs)).cache()
    quota = {r["place"]: r["quota"] for r in table.collect()}
    slots = mixing.schedule(spark, table)
    assert {r["place"]: (r["n"], r["top"], r["d"]) for r in slots.groupBy("place").agg(F.count("*").alias("n"), F.max("rank").alias("top"), F.countDistinct("rank").alias("d")).collect()} == {p: (q, q - 1, q) for p, q in quota.items()}
    total = sum(quota.values())
    part = {r["place"]: r["n"] for r in slots.where(F.col("slot") < total // 7).groupBy("place").agg(F.count("*").alias("n")).collect()}
    # A source's points never run far ahead of or behind its share.
    assert slots.where(F.col("slot") == total).count() <= 2 * len(quota)
    for p, q in quota.items():  # any stretch of the mix has the sources in proportion
        assert abs(part[p] - q / 7) < 8


def test_mix_stands_in_the_order_of_its_slots(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}-{k}" for k in range(9 + i % 40)), "en", "abc"[i % 3], 1) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    places = {r["doc_id"]: list(r["slots"]) for r in mixing.mix(docs).collect()}
    given = mixing.contributions(docs).collect()
    for r in given:
        assert [r[f"slot_{k}"] for k in (0, 1) if r[f"taken_{k}"]] == places[r["doc_id"]] and all((r[f"slot_{k}"] is None) == (r[f"taken_{k}"] == 0) for k in (0, 1))
    order, taken = {}, 0
    for r in mixing.mixed_documents(docs).withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).orderBy("at").collect():
        order.setdefault(r["p"], []).append(r["doc_id"])
        taken += 1
    assert taken == sum(map(len, places.values()))
    for ids in order.values():  # each document's first row stands by its first slot
        firsts = [places[i][0] for k, i in enumerate(ids) if i not in ids[:k]]
        assert firsts == sorted(firsts)
    # Below the join the texts pass one exchange, the one of the window, on the mark alone.
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert sum(re.search(r"Exchange hashpartitioning\(_mark#\w+, \d+\)", line) is not None for line in plan.splitlines()) == 2, plan


def test_closed_form(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(map(tuple, con.sql(mixing.SQL).fetchall()))
    assert sorted(map(tuple, mixing.query(spark, sf).collect())) == want
