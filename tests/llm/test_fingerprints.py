import hashlib
import unicodedata

import xxhash
from pyspark.sql import functions as F

from clinspan.llm import fingerprints


def form(t):
    t = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())
    return " ".join(t.split())


def slow(rows, bits=128):
    """rows: (doc_id, text). Digests without suffixes."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        d = [xxhash.xxh3_128_hexdigest(form(x).encode())[: bits // 4] for x in (t, e, n)]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), d[0], d[1], float(form(t) == form(e)), float(form(t) == form(n))))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def test_edges_of_input(spark):
    rows = [(4, "Straße  é"), (4, "STRASSE é"), (3, "a"), (2, None), (1, ""), (0, "ﬁ ①"), (None, "x"), (None, None), (9, "q\n" * 60000), (-5, "𝔘𝔫𝔦 code")]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, digest string, `range` int")
    got = fingerprints.edited_fingerprints(docs).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)
    one = spark.createDataFrame([(7, "alone")], "doc_id long, text string")
    assert [tuple(r) for r in fingerprints.edited_fingerprints(one).select(*COLUMNS).collect()] == slow([(7, "alone")])
    assert fingerprints.edited_fingerprints(docs.limit(0)).count() == 0


def test_equal_digests_of_other_bytes_are_told_apart(spark):
    rows = [(i, f"text {i % 40}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in fingerprints.canonical_classes(docs, bits=4).collect()}
    for i in range(80):
        assert got[i]["class_id"] == i % 40 and got[i]["class_size"] == 2
    assert any("-" in r["fingerprint"] for r in got.values())
    named = {r["doc_id"]: r["fingerprint"] for r in fingerprints.edited_fingerprints(docs, bits=4).collect()}
    assert len(set(named.values())) == 40 and all(named[i] == named[i % 40] for i in range(80))


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, fingerprints.query(spark, sf).select(*COLUMNS).collect()), key=str) == slow(rows)


def test_ids_that_fill_several_ranges(spark):
    # A third of the rows without an id, a third of one id, equal rows among them; texts that begin alike.
    rows = [(None, f"{'same ' * 40}{i * 7 % 50}") for i in range(50)] + [(5, f"{i * 13 % 60:03d} Text") for i in range(60)]
    rows += [(5, "equal")] * 12 + [(None, None)] * 9 + [(i, f"tail {i}") for i in range(-20, 30)] + [(2**62 + i, "far") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = fingerprints._dealt(texts, 12).collect()
    order = sorted(dealt, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["text"]))
    assert [r["range"] for r in order] == sorted(r["range"] for r in order)
    assert len({r["range"] for r in dealt if r["doc_id"] == 5}) > 1
    got = fingerprints.edited_fingerprints(docs).select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == slow(rows)


def test_texts_are_read_once(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string").write.parquet(path)
    dealt = fingerprints._dealt(spark.read.parquet(path), 8)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema") == 1
    assert dealt.groupBy("range").count().count() > 4
