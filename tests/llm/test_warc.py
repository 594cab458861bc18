import base64
import hashlib
import os
import subprocess
import sys

import pytest

from clinspan.llm import warc


def facts(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        f = first.get(h or "")
        response = i == f
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else f))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip_and_rolling(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 11)) for i in range(300)]
    rows += [(None, None, "<p>1</p>"), (5, "http://x/5", "<p>5</p>" * 5), (-(2**62), "a b\nc", None), (2**62, "é", "é\r\n\r\n" * 9), (400, None, "z" * 200000)]
    pages = spark.createDataFrame([(*r, 1, "s") for r in rows], "page_id long, url string, html string, shard int, sha string")
    uri = f"file://{tmp_path}/w"
    manifest = warc.write_archives(pages, uri, shard_bytes=2000, file_bytes=900)
    files = manifest.collect()
    assert len({f["file"] for f in files}) == len(files) > 5 and sum(f["records"] for f in files) == len(rows)
    assert max(f["part"] for f in files) > 0 and not os.path.exists(f"{tmp_path}/w/_temporary")
    assert {f["file"]: f["sha256"] for f in files} == {n: hashlib.sha256(open(f"{tmp_path}/w/{n}", "rb").read()).hexdigest() for n in os.listdir(f"{tmp_path}/w") if n.endswith(".gz")}
    back = warc.read_archives(manifest, uri)
    assert got(back) == facts(rows)
    kept = {r["page_id"]: bytes(r["payload"]) for r in back.where("record_type = 'response'").collect()}
    assert kept[400] == b"z" * 200000 and kept[2**62] == "é\r\n\r\n".encode() * 9
    again = warc.write_archives(pages.repartition(5), f"file://{tmp_path}/w2", shard_bytes=2000, file_bytes=900)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in files}  # the same bytes, however the rows were dealt
    out = subprocess.run([sys.executable, "-c", f"import gzip,glob; print(sum(gzip.open(f).read().count(b'WARC/1.1') for f in glob.glob('{tmp_path}/w/*.gz')))"], capture_output=True, text=True)
    assert int(out.stdout) == len(rows)


def test_heavy_ids_and_hot_payloads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT_COPIES", 20)
    rows = [(None, "n", f"<b>{i % 90}</b>" * 9) for i in range(200)] + [(7, "s", f"<i>{i}</i>" * 9) for i in range(200)]
    rows += [(i, "u", "") for i in range(100, 200)] + [(i, "u", f"<u>{i % 60}</u>") for i in range(200, 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    facts_ = warc._facts(pages)
    plan = warc.plan_shards(facts_, 1500)
    assert plan.pieces[0] > 5 and plan.pieces.max() > 5 and plan.count == plan.pieces.sum()
    loads = {r["shard"]: r["size"] for r in facts_.groupBy(plan.of("page_id", "sha").alias("shard")).sum("size").withColumnRenamed("sum(size)", "size").collect()}
    assert set(loads) <= set(range(plan.count)) and max(loads.values()) < 3 * 1500
    monkeypatch.setattr(warc, "MOST_SHARDS", 4)
    assert warc.plan_shards(facts_, 1500).count <= 2 * 4
    uri = f"file://{tmp_path}/h"
    assert got(warc.read_archives(warc.write_archives(pages, uri, shard_bytes=1500), uri)) == facts(rows)


def test_empty_and_damaged(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = warc.write_archives(none, f"file://{tmp_path}/e")
    assert warc.read_archives(manifest, f"file://{tmp_path}/e").count() == 0
    one = warc.write_archives(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), f"file://{tmp_path}/d")
    with open(f"{tmp_path}/d/{one.first()['file']}", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="another size"):
        warc.read_archives(one, f"file://{tmp_path}/d").collect()


def test_whole_table_against_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(warc.query(spark, sf)) == facts(rows)
