import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from clinspan.llm import mixing, packing, secret_scan, toxicity


def test_stages_take_effect_and_agree_with_run(spark, tmp_path):
    """Each stage against a plain version of it on the rows that its predecessor kept."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    before = docs
    kept = {}
    for name in list(steps)[:-1]:
        after = steps[name](spark, before, sf)
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        kept[name] = (before, after := spark.read.parquet(f"{tmp_path}/{name}"))
        before = after
    rows, population = toxicity.training_rows(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    tagger = toxicity.Tagger(toxicity.fit(rows, population=population))
    every = docs.collect()
    scores = tagger.tag([r["text"] or "" for r in every])[2]
    want = {r["doc_id"] for r, s in zip(every, np.round(scores, 9), strict=True) if s < 0.5}
    assert {r["doc_id"] for r in kept["toxicity"][1].select("doc_id").collect()} == want

    left = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in kept["near_duplicates"][0].collect()}
    left = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in left.items()}
    parent = {i: i for i in left}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in left.items():
        for j, b in left.items():
            if i < j and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert {r["doc_id"] for r in kept["near_duplicates"][1].collect()} == {i for i in parent if find(i) == i}

    was, now = (sorted(map(tuple, d.collect())) for d in kept["secrets"])
    for a, b in zip(was, now, strict=True):
        spans = secret_scan.spans_of(a[1])
        assert a == b if not spans else (b[1] == secret_scan.redact(a[1]) and b[4] == len(b[1]) and "[SECRET]" in b[1])

    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(kept["mixing"][0]).collect()}
    given = {}
    for r in kept["mixing"][1].collect():
        assert r["n_chars"] == len(r["text"])
        given[r["doc_id"]] = given.get(r["doc_id"], 0) + len(r["text"].encode().split())
    assert given == {i: n for i, n in taken.items() if n}

    last = steps["packing"](spark, before, sf)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, last.select(*key).collect()))
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where(f"n > {packing.CAPACITY}").count() == 0


def test_edges_of_input(spark, tmp_path):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words here", "en", None, 15), (None, "some words here", "en", None, 15), (3, ' lead token = "0123456789abcdef" tail', "en", "b", 36), (4, "x y " * 3000, None, "b", 12000), (4, "x y " * 3000, None, "b", 12000), (5, "other text of a few words é", "fr", "c", 27)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} >= {4, 5}
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_cut_after_the_last_word_taken(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}-{k}" for k in range(9)), "en", "ab"[i % 2], 1) for i in range(7)], "doc_id long, text string, lang string, source string, n_chars long")
    given = {r["doc_id"]: (r["taken_0"], r["taken_1"]) for r in mixing.contributions(docs).collect()}
    got = {}
    for r in mixing.mixed_documents(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, takes in given.items():
        assert sorted(got.get(i, [])) == sorted(" ".join(f"w{i}-{k}" for k in range(n)) for n in takes if n)
