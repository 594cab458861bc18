"""Token counts, transport streams, licences, secrets and toxicity against plain versions."""

import hashlib
import random
import re
import time
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clinspan.llm import license_scan, mpeg_ts, pretokens, secret_scan, token_counts, toxicity

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def texts_of(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def odd_texts():
    rng = random.Random(3)
    letters = [chr(i) for i in range(0x250)] + list("     \n\n\t'''std <|endoftext|>–—“”…€’") * 6 + list("中文字 éΣσς́​\U0001f600")
    few = list("ab1.  \n\t\xa0's\rÉ")
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    out += ["".join(rng.choice(few) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    return [*out, "", " ", "a<|endoftext|>b <|startoftext|> c", "x" * 3000, "word " * 3000]


def test_pretokens_agree_with_the_library():
    counts, ids = pretokens.ByteLevelCounts(BYTES, token_counts.frequent_lengths(BYTES)), pretokens.WordLevelIds(WORDS)
    for text in odd_texts():
        assert counts.count(text) == len(counts.whole(text)), text
        assert ids.ids(text) == pretokens.packed(ids.whole(text)), text


def test_token_counts(spark):
    rows = [(1, None), (1, ""), (None, "a b"), (None, "a b"), (2, "word " * 5000), (3, "é<|endoftext|> 中"), (4, "\x1c\x85")]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, n_tokens int, over_limit string")
    library = Tokenizer.from_file(BYTES)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted(((i, len((t or "").encode()), n(t), n(t) > 1024) for i, t in rows), key=str)
    assert sorted(map(tuple, token_counts.count_tokens(docs, BYTES).collect()), key=str) == want
    assert sorted(map(tuple, token_counts.count_tokens(docs, BYTES, pretokens=["a", " b"]).collect()), key=str) == want
    assert token_counts.count_tokens(docs.limit(0), BYTES).count() == 0
    texts = texts_of(spark)
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.query(spark, SF).collect()} == {i: n(t) for i, t in texts.items()}


def test_transport_stream_round_trip(spark):
    for n in [*range(0, 400, 7), 32767, 32768, 32769, 200000]:
        data = random.Random(n).randbytes(n)
        stream = mpeg_ts.demux(media := mpeg_ts.mux(data))
        assert len(media) % 188 == 0 and b"".join(u.payload for u in stream.units) == data
        assert not (stream.counter_errors or stream.duplicates or stream.lost_sync or stream.bad_tables)
    media = mpeg_ts.mux(random.Random(1).randbytes(200000))
    whole = mpeg_ts.demux(media)
    assert [u.pts for u in whole.units] == [i * 3600 for i in range(7)] and [u.random_access for u in whole.units] == [i % 4 == 0 for i in range(7)]
    lost = mpeg_ts.demux(media[: 188 * 50] + media[188 * 51 :])
    assert lost.counter_errors == 1 and sum(u.damaged for u in lost.units) == 1
    assert mpeg_ts.demux(media[: 188 * 50] + media[188 * 49 :]).duplicates == 1
    assert len(mpeg_ts.demux(b"xyz" + media).units) == 7
    broken = bytearray(media)
    broken[10] ^= 1
    assert mpeg_ts.demux(bytes(broken)).bad_tables == 1

    rows = [(1, None), (2, ""), (None, "é" * 64), (2, "a" * 64), (3, "b" * 300000), (4, "\x00")]
    docs = spark.createDataFrame([(*r, b"1") for r in rows], "doc_id long, text string, media binary")
    got = sorted(map(tuple, mpeg_ts.media_features(mpeg_ts.store_texts(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()), key=str)
    want = []
    for i, t in rows:
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        want.append((i, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert got == sorted(want, key=str)
    assert mpeg_ts.media_units(mpeg_ts.store_texts(docs)).where("doc_id = 3").count() == 10
    assert mpeg_ts.media_features(mpeg_ts.store_texts(docs.limit(0))).count() == 0


def test_media_query_on_a_whole_table(spark):
    rows = {r["doc_id"]: r for r in mpeg_ts.query(spark, SF).collect()}
    texts = texts_of(spark)
    assert rows.keys() == texts.keys()
    for i, text in texts.items():
        data = (text or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (0 if data else 64))
        r, media = rows[i], mpeg_ts.mux(padded)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_base_phrases_and_fuzzy_notices(spark):
    def plain(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        hits = [(i, label) for p, label in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))

    rows = [(1, None), (2, ""), (3, "CC-BY cc  by\ncc by cc"), (None, "ALL rights, reserved! All Rights Reserved"), (4, "General Public License é" * 2), (5, "Licensd under teh Apache License, Version 2.0"), (6, "x " * 60000 + "Released under the MIT Licence"), (7, "accby ccby cc byé")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[5]["labels"] == "apache-2.0" and got[5]["n_base"] == 0 and 0.9 < got[5]["score"] < 1
    hit = got[6]["found"][0]
    assert rows[6][1][hit["start"] : hit["end"]] == "Released under the MIT Licence" and hit["edits"] == 1 and hit["first_word"] == 60000
    texts = texts_of(spark)
    for r in license_scan.query(spark, SF).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain(texts[r["doc_id"]])


def test_pigeonhole_loses_no_match():
    import regex

    rng = random.Random(2)
    search = license_scan.searcher(license_scan.NOTICES)
    for notice in search.notices:
        for _ in range(10):
            chars = list(notice.text)
            for _ in range(rng.randint(0, notice.errors)):
                chars[rng.randrange(len(chars))] = rng.choice("abcxyz ")
            line = "some words before " + "".join(chars) + " and after"
            assert regex.search(rf"(?:{notice.text}){{e<={notice.errors}}}", line)
            assert any(search.notices[i].label == notice.label for _, _, i, _ in search.search(line))


def test_license_scan_of_repetitive_texts():
    """Work in proportion to the text: each of these took minutes or more with windows that merge."""
    import time

    for piece, label, n in (("Licensd under teh Apache License, Version 2.0. ", "apache-2.0", 10_000), ("all rights reserved ", "reserved", 10_000), ("redistribution and use in sorce and binary forms ", None, 0), ("licensed ", None, 0)):
        begin = time.time()
        r = license_scan.scan_text(piece * 10_000)
        assert time.time() - begin < 30
        assert len(r["found"]) == n and r["labels"] == (label or "")
    text = "licensed under the apache lisence version 2 0 licensed under the apache license version 2 0"
    assert [(h["first_word"], h["edits"]) for h in license_scan.scan_text(text)["found"]] == [(0, 2), (8, 0)]


def plain_scan(line, search):
    """(labels, score) of all windows of a line, without seeds: the best match from each place on, then the longest notice
    and the fewest edits of each label."""
    found = set()
    for i, n in enumerate(search.notices):
        for start in range(-n.errors, len(line)):
            m = search.patterns[i].search(line, max(0, start - n.errors), max(0, start + len(n.text) + n.errors))
            if m:
                found.add((-len(n.text), sum(m.fuzzy_counts), m.start() - m.end(), m.start(), i))
    kept = []
    for m in sorted(found):
        label, a, b = search.notices[m[4]].label, m[3], m[3] - m[2]
        if all(label != x or b <= c or a >= d for x, c, d, _ in kept):
            kept.append((label, a, b, 1 + m[1] / m[0]))
    return {x for x, *_ in kept}, max((s for *_, s in kept), default=0.0)


def least_edits(text, line):
    """The fewest edits between text and any stretch of line (one column of distances as two words of bits)."""
    at = {}
    for i, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(text)) - 1, 1 << len(text) - 1
    up, down, now = full, 0, len(text)
    least = now
    for c in line:
        eq = at.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(x | up) & full, up & x
        now += bool(more & top) - bool(less & top)
        least = min(least, now)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(x | more) & full, more & x
    return least


def test_license_labels_and_scores_against_plain_search(spark):
    assert [least_edits("abcd", t) for t in ("", "xxabcdxx", "abd", "abxcd", "xx")] == [4, 0, 1, 1, 4]
    rng = random.Random(6)
    search = license_scan.searcher(license_scan.NOTICES)
    for _ in range(12):
        parts = []
        for _ in range(rng.randint(1, 2)):
            chars = list(rng.choice(search.notices).text)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(chars))
                chars[at : at + rng.randint(0, 1)] = rng.choice(["", "x", " ", "ab"])
            parts += ["".join(chars), rng.choice(["and", "licensed under", "license"])]
        text = " ".join(parts)
        line, _ = license_scan.folded(text)
        labels, score = plain_scan(line, search)
        base = {label for _, label in license_scan.base_places(line)}
        r = license_scan.scan_text(text)
        assert set(filter(None, r["labels"].split(","))) == labels | base, text
        assert r["score"] == pytest.approx(1.0 if base else score), text
    texts = texts_of(spark)
    for r in license_scan.query(spark, SF).collect():
        line, _ = license_scan.folded(texts[r["doc_id"]] or "")
        want = {n.label for n in search.notices if least_edits(n.text, line) <= n.errors} | {label for _, label in license_scan.base_places(line)}
        assert set(filter(None, r["labels"].split(","))) == want


def plain_spans(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark):
    key = "Zq9rT4xW8pLm2NvB6cYd1"
    linked = f"client_id: abc123\nkey {key}\nhost: db.example.com:5432\n\n{key}"
    assert [(secret_scan.KINDS[k], linked[a:b]) for a, k, b in secret_scan.spans_of(linked)] == [("linked_id", "abc123"), ("linked_secret", key), ("linked_endpoint", "host: db.example.com:5432")]
    for alone in (key, "client_id: abc123", "host: db.example.com", "see https://example.com and user: someone"):
        assert secret_scan.spans_of(alone) == []
    far = "client_id: abc123" + " word" * 60 + f" {key}"
    assert secret_scan.spans_of(f"client_id: abc123\n\n{key}") == [] == secret_scan.spans_of(far, reach=200)
    assert [k for _, k, _ in secret_scan.spans_of(far)] == [3, 4]  # a paragraph is one scope, however long it is
    long_key = key * 9
    assert [(k, b - a) for a, k, b in secret_scan.spans_of(f"client_id: abc123 {long_key}")] == [(3, 6), (4, len(long_key))]
    for size in (1, 64, 65, 10_000, 200_000):  # a user's name of any length
        user, address = "u" * size, f"postgres://{'u' * size}:{key}@db.example.com/x"
        assert {(secret_scan.KINDS[k], address[a:b]) for a, k, b in secret_scan.spans_of(address)} == {("linked_id", user), ("linked_secret", key), ("linked_endpoint", address)}
        assert secret_scan.redact(f"see {address} there") == "see [SECRET] there"
    for piece in ("://", "://u", "://u:", "://u:pppppp", "u:"):
        began = time.perf_counter()
        secret_scan.spans_of(piece * 50_000)
        assert time.perf_counter() - began < 10
    for address, user in ((f"postgres://svc:{key}@db.example.com/x", "svc"), (f"https://example.com/?client_id=abc123&key={key}", "abc123")):
        assert {(secret_scan.KINDS[k], address[a:b]) for a, k, b in secret_scan.spans_of(address)} == {("linked_id", user), ("linked_secret", key), ("linked_endpoint", address)}
    rng = random.Random(4)
    pieces = ["token", "Secret", "api_key", "APIKEY", "paſſword", "=", ":", " ", '"', "abcdefgh", "0123456789abcdef" * 2, "AKIA", "ABCDEFGH1234", "AKIA1", "é", "a=b", "-", "\n", "x" * 8]
    odd = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000)] + [*texts_of(spark).values()]
    for text in odd:
        spans = secret_scan.spans_of(text)
        assert [s for s in spans if s[1] < 3] == plain_spans(text), text
        clean = secret_scan.redact(text)
        assert clean == text if not spans else "[SECRET]" in clean
    rows = [(1, None), (2, ""), (None, "token = 12345678"), (2, "a" * 40 + " " * 200000 + "secret: zzzzzzzz")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, spans int")
    got = {(r["doc_id"], r["spans"]): (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secret_scan.scan_secrets(docs).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[(1, "")] == (0, 0, 0, sha("")) and got[(None, "assign:0:16")] == (1, 0, 0, sha("assign:0:16"))
    assert got[(2, "hex:0:40,assign:200040:200056")] == (1, 0, 1, sha("hex:0:40,assign:200040:200056"))


def test_linking_against_all_pairs():
    rng = random.Random(8)
    key = "Zq9rT4xW8pLm2NvB6cYd1"
    pieces = ["client_id: abc123", "user_name=someone", "AKIA" + "B7" * 8, "token = 0123456789", "ab12" * 8, f" {key} ", f"{key[::-1]}=", "https://example.com/a", "host: db.example.com", f"redis://me:{key}@cache:1/0", f"http://x.org/?uid=someone&k={key}", "\n\n", "\n \n", " ", ", ", "words between"]

    def apart(x, y):
        return max(0, y[0] - x[1], x[0] - y[1])

    linked = 0
    for _ in range(3000):
        text = " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        reach = rng.choice([None, 0, 5, 30])
        base = secret_scan.base_spans(text)
        ids, secrets, ends = secret_scan.parts_of(text, base, text.lower())
        borders = [m.start() for m in secret_scan.PARAGRAPH.finditer(text)]
        scope = lambda x: sum(at <= x[0] for at in borders)  # noqa: B023, E731
        meets = lambda x, others: any(scope(x) == scope(y) and (reach is None or apart(x, y) <= reach) for y in others)  # noqa: B023, E731
        all_ids, all_secrets = ids | {(a, b) for a, k, b in base if k == 1}, secrets | {(a, b) for a, k, b in base if k != 1}
        want = {(*x, 3) for x in ids if meets(x, all_secrets)} | {(*x, 4) for x in secrets if meets(x, all_ids)}
        want |= {(*x, 5) for x in ends if meets(x, all_ids) and meets(x, all_secrets)}
        got = secret_scan.linked_spans(text, base, reach=reach)
        assert {(a, b, k) for a, k, b in got} == want and len(got) == len(want), text
        linked += len(want)
    assert linked > 3000


def test_secret_query_on_a_whole_table(spark):
    texts = texts_of(spark)
    sha = lambda spans: hashlib.sha256(",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
    rows = secret_scan.query(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]] or "")
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for _, k, _ in base) for n in range(3)) and r["base_sha256"] == sha(base)
    docs = spark.createDataFrame([(1, "token = 12345678")] * 3 + [(None, "client_id: abc123 Zq9rT4xW8pLm2NvB6cYd1")] * 2, "doc_id long, text string")
    assert secret_scan.scan_secrets(docs).distinct().count() == 2 and secret_scan.scan_secrets(docs).count() == 5
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def brute_chain(odds, start, steps):
    """All tag sequences of one text."""
    from itertools import product
    from math import exp

    ot, to, tt = steps
    move = {(0, 0): 0.0, (0, 1): ot, (1, 0): to, (1, 1): tt}
    total, mass = 0.0, [0.0] * len(odds)
    for tags in product((0, 1), repeat=len(odds)):
        s = start * tags[0] + sum(o * t for o, t in zip(odds, tags, strict=True)) + sum(move[p] for p in zip(tags, tags[1:], strict=False))
        total += exp(s)
        for i, t in enumerate(tags):
            mass[i] += t * exp(s)
    return [m / total for m in mass]


def test_marginals_against_all_sequences():
    import numpy as np

    rng = np.random.default_rng(1)
    lengths = np.array([0, 5, 1, 9, 3])
    odds = rng.normal(size=lengths.sum())
    start, steps = 0.3, (-1.2, 0.4, 0.9)
    chain = toxicity.Packed(lengths)
    packed = np.empty(len(odds))
    packed[chain.place] = odds
    tox = toxicity.marginals(packed, chain, start, steps)[0][chain.place]
    at = 0
    for n in lengths:
        assert n == 0 or tox[at : at + n] == pytest.approx(brute_chain(odds[at : at + n].tolist(), start, steps))
        at += n


def test_toxicity_on_rows_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = toxicity.query(spark, sf).collect()
    assert len(out) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.9


def test_document_scores_against_all_sequences():
    """Scores of short texts from the weights, by all tag sequences and plain sums."""
    from math import exp, log

    rows = [(f"you are a stupid idiot person {i % 9}" if i % 2 else f"the good day is a fine one {i % 9}", i % 2) for i in range(120)]
    model = toxicity.fit(rows)
    tagger = toxicity.Tagger(model)
    texts = ["", "stupid", "Good day, you stupid idiot", "stupid stupid idiot idiot fine day", "a fine one", "what is this_person doing"]
    for text, score in zip(texts, tagger.tag(texts)[2], strict=True):
        words = toxicity.TOKEN.findall(text.lower())
        odds = [model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words]
        best = {}
        for w, p in zip(words, brute_chain(odds, model.start, model.steps) if odds else [], strict=True):
            if p > toxicity.LEAST_MARGINAL:
                best[w] = max(best.get(w, 0.0), min(p, 1 - 1e-9))
        none = sum(log(1 - p) for p in best.values())
        mass = sum(best.values())
        some = max(-8, min(8, log(1 - exp(min(none, -1e-9))) - none))
        features = [1, some, log(mass + 0.1), log((mass + 0.1) / (len(set(words)) + 20))]
        assert score == pytest.approx(1 / (1 + exp(-sum(a * b for a, b in zip(features, model.link, strict=True)))), rel=1e-6), text


def plain_marginals(odds, start, steps):
    """P(toxic) of each word by scaled sums forwards and backwards, word by word."""
    from math import exp

    ot, to, tt = map(exp, steps)
    forward, backward = [], [(1.0, 1.0)]
    for i, o in enumerate(odds):
        a, b = forward[-1] if i else (0.0, 0.0)
        pair = (a + b * to, (a * ot + b * tt) * exp(o)) if i else (1.0, exp(start + o))
        forward.append((pair[0] / sum(pair), pair[1] / sum(pair)))
    for o in reversed(odds[1:]):
        a, b = backward[-1][0], backward[-1][1] * exp(o)
        pair = (a + ot * b, to * a + tt * b)
        backward.append((pair[0] / sum(pair), pair[1] / sum(pair)))
    return [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, reversed(backward), strict=False)]


def test_toxicity_of_a_whole_table_against_plain_sums(spark):
    """Scores and offending places of every document, by the query and word by word."""
    from math import exp, log

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows, population = toxicity.training_rows(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    model = toxicity.fit(rows, population=population)
    got = {r["doc_id"]: r for r in toxicity.query(spark, sf).collect()}
    table = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert got.keys() == table.keys()
    n_spans = 0
    for doc_id, text in table.items():
        low = toxicity.lowered(text)
        places = [m.span() for m in toxicity.TOKEN.finditer(low)]
        words = [low[a:b] for a, b in places]
        tox = plain_marginals([model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(w)) for w in words], model.start, model.steps) if words else []
        best = {}
        for w, p in zip(words, tox, strict=True):
            if p > toxicity.LEAST_MARGINAL:
                best[w] = max(best.get(w, 0.0), min(p, 1 - 1e-9))
        none, mass = sum(log(1 - p) for p in best.values()), sum(best.values())
        some = max(-8, min(8, log(1 - exp(min(none, -1e-9))) - none))
        shape = [1, some, log(mass + 0.1), log((mass + 0.1) / (len(set(words)) + 20))]
        assert got[doc_id]["score"] == pytest.approx(1 / (1 + exp(-sum(a * b for a, b in zip(shape, model.link, strict=True)))), abs=1e-6)
        spans = []
        for i, p in enumerate(tox):
            if p >= toxicity.SPAN_LEVEL:
                if spans and spans[-1][2] == i - 1:
                    spans[-1][1:] = [places[i][1], i]
                else:
                    spans.append([*places[i], i])
        assert got[doc_id]["toxic_spans"] == ",".join(f"{a}:{b}" for a, b, _ in spans)
        n_spans += len(spans)
    assert n_spans > 50


def test_repeated_ids_count_once_in_the_sample(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(40) for k in range(1 if i % 7 else 50)], "doc_id long, text string")
    rows, _ = toxicity.training_rows(docs, labels, toxicity.Settings(documents=100))
    assert sorted(rows) == sorted((f"text {i} 0", i % 2) for i in range(40) if zlib.crc32(str(i).encode()) % 5)


def test_training_sample(spark):
    """The smallest hashes of each label among rows that may be learnt from, also where most labelled ids lack a text."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, 0), (None, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, f"text {i}" if i % 3 else "long " * 9) for i in range(300, 400)], "doc_id long, text string")
    rows, population = toxicity.training_rows(docs, labels, toxicity.Settings(documents=10, chars=20))
    fit = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    assert population == (sum(i % 2 == 0 for i in fit) + (3 in fit), sum(i % 2 for i in fit))
    order = [r["doc_id"] for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    for label in (0, 1):
        want = [f"text {i}" for i in order if i in fit and i % 3 and i % 2 == label][:10]
        assert [t for t, y in rows if y == label] == want and len(want) == 10


def test_toxicity_edges_of_input(spark):
    rows = [(i, "you are a stupid idiot person" if i % 2 else "the good day is a fine one") for i in range(60)]
    model = toxicity.fit([(t, i % 2) for i, t in rows] + [(f"{t} {i}", i % 2) for i, t in rows for _ in range(3)])
    odd = [(1, None), (2, ""), (None, "stupid idiot"), (2, "fine " * 30000), (3, "stupid idiot"), (3, "stupid idiot")]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in odd], "doc_id long, text string, score double, predicted int")
    out = toxicity.score_documents(docs, model).collect()
    assert len(out) == len(odd) and len({r["score"] for r in out if r["n_tokens"] == 2}) == 1
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    assert toxicity.without_toxic(docs, model).columns == docs.columns
    one = toxicity.fit([("only one label", 0)])
    assert all(r["predicted"] == 0 for r in toxicity.score_documents(docs, one).collect())
    assert toxicity.score_documents(docs, toxicity.fit([])).where(F.col("predicted") == 0).count() == len(odd)
    whole = "ａ" * 95 + "_stupid_idiot"  # no blanks: every piece is tagged
    assert [len(w) for w in toxicity.TOKEN.findall(toxicity.lowered(whole))] == [40, 40, 15, 6, 5]
    turkish = "İİİ stupid"
    spans = toxicity.offending(turkish, __import__("numpy").array([0.1, 0.9]))
    assert [turkish[s["start"] : s["end"]] for s in spans] == ["stupid"]
    spans = toxicity.offending("A stupid, idiot!", __import__("numpy").array([0.1, 0.9, 0.8]))
    assert [("A stupid, idiot!"[s["start"] : s["end"]]) for s in spans] == ["stupid, idiot"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_other_tokenizers(spark, name):
    """A tokenizer of another kind counts by its own library; only the known one goes through the two tiers."""
    import sentencepiece

    path = public_tokenizers.path(name)
    assert token_counts.splits_as_byte_level(str(path)) == (name == "byte_bpe_50k.json")
    texts = ["Plain words, and MORE of them!", "été 12345  two  blanks\n", "", "漢字 <|endoftext|> x", "don't we'll " * 300]
    if name.endswith(".model"):
        ids = sentencepiece.SentencePieceProcessor(model_file=str(path)).encode
    else:
        tokenizer = Tokenizer.from_file(str(path))
        tokenizer.no_truncation()
        ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, path).collect()}
    assert got == {i: len(ids(t)) for i, t in enumerate(texts)}
