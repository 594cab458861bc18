import random

import numpy as np
import xxhash

from clinspan.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, radius=3):
    """rows: (doc_id, fp). The smallest id that each position reaches."""
    n = len(rows)
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                parent[find(i)] = find(j)
    best = {}
    for i in range(n):
        if rows[i][0] is not None:
            best[find(i)] = min(best.get(find(i), rows[i][0]), rows[i][0])
    return [best.get(find(i)) for i in range(n)]


def test_fingerprint_is_the_majority_of_hashes():
    for text in ["", " \t\n", "one", "Two words", "a b c", "The THE the the the the", "é \x85 x\x1cy  z\x0bw", "k" * 5000, " ".join(map(str, range(30000)))]:
        assert simhash.text_fingerprint(text) == slow_fingerprint(text)


def test_linked_finds_every_pair(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    fps = set(seeds)
    for s in seeds:
        for _ in range(40):
            x = s
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    # a chain that no two far ends of link directly
    x = rng.getrandbits(64)
    for b in range(0, 60, 3):
        x ^= 7 << b
        fps.add(x)
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    signed = [(f - (1 << 64) if f >> 63 else f,) for _, f in rows]
    want = dict(zip((f for _, f in rows), slow_components(rows), strict=True))
    for split_rows in (1000, 7):
        links = simhash.near_links(spark.createDataFrame(signed, "fp long"), split_rows=split_rows)
        for a, b in links.collect():
            assert ((a ^ b) & (2**64 - 1)).bit_count() <= 64
        got = {r["node"] % 2**64: r["root"] % 2**64 for r in simhash.components(links).collect()}
        groups = {}
        for f, c in want.items():
            groups.setdefault(c, set()).add(f)
        for members in groups.values():
            roots = {got.get(f, f) for f in members}
            assert len(roots) == 1 and roots <= members


def test_radius_smaller(spark):
    base = 0x0123456789ABCDEF
    fps = [base, base ^ 1, base ^ 7, base ^ 0xF]
    for radius, n in ((0, 0), (1, 2), (2, 3), (3, 3)):
        links = simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), radius=radius)
        pairs = {(min(a, b), max(a, b)) for a, b in links.collect()}
        parent = slow_components(list(enumerate(fps)), radius)
        assert len(set(parent)) == 4 - len(simhash.components(links).where("node <> root").collect())


def test_near_duplicates_edges_of_input(spark):
    words = [f"w{i}" for i in range(400)]
    long = " ".join(words)
    near = " ".join([*words[:200], "other", *words[201:]])
    rows = [(5, long), (3, long), (9, near), (None, long), (7, None), (8, ""), (8, ""), (2, " \n"), (11, "x " * 40000), (12, "completely different text of some words")]
    docs = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id long, text string, fingerprint string, component_id string, fp int")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    plain = [(i, slow_fingerprint(t)) for i, t in rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(plain, slow_components(plain), strict=True)), key=str)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table_against_brute_force(spark):
    import os

    sf = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    rows = [(r["doc_id"], slow_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {(i, f"{f:016x}", c) for (i, f), c in zip(rows, slow_components(rows), strict=True)}
    assert {tuple(r) for r in simhash.query(spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_bit_planes():
    fps = np.array([[1], [2], [3], [1 << 63]], dtype=np.uint64)
    planes = simhash.bit_planes(fps)
    assert planes[0, 0] == 0b101 and planes[1, 0] == 0b110 and planes[63, 0] == 0b1000


def test_bit_sliced_distances_of_wide_fingerprints():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, size=(1, 4), dtype=np.uint64)
    fps = np.repeat(base, 150, axis=0)
    for i in range(150):
        for b in rng.choice(256, size=i // 2, replace=False):
            fps[i, b // 64] ^= np.uint64(1 << int(b % 64))
    planes = simhash.bit_planes(fps)
    wide = [int.from_bytes(f.tobytes(), "little") for f in fps]
    query, block = np.repeat(np.arange(150), 3), np.tile(np.arange(3), 150)
    lanes = np.where(block == 2, np.uint64((1 << 22) - 1), np.uint64(0xFFFFFFFFFFFFFFFF))
    for radius in (0, 1, 3, 7, 20, 37):
        item, near = simhash.close_lanes(planes, fps, query, block, lanes, radius)
        got = {(int(query[i]), int(block[i]) * 64 + k) for i, m in zip(item, near, strict=True) for k in range(64) if int(m) >> k & 1}
        assert got == {(i, j) for i in range(150) for j in range(150) if (wide[i] ^ wide[j]).bit_count() <= radius}


def test_similar_documents(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    rows = []
    for g in range(20):
        base = rng.sample(words, 400)
        rows.append((g * 10, " ".join(base)))
        for c in range(1, 4):  # three changed words: at most 15 of 396 shingles on either side
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(400)] = "x"
            rows.append((g * 10 + c, " ".join(copy)))
        far = list(base)
        for k in range(0, 400, 8):
            far[k] = "y"
        rows.append((g * 10 + 5, " ".join(far)))
    rows += [(900, None), (901, ""), (902, "short text"), (903, "short  TEXT"), (904, "short other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs, split_rows=50).collect()}
    want = {i: i if i % 10 == 5 else i - i % 10 for i, _ in rows if i < 900} | {900: 900, 901: 900, 902: 902, 903: 902, 904: 904}
    assert got == want
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == {i for i, c in want.items() if i == c}


def test_similar_documents_against_exact_similarity(spark):
    """Pairs at, above and below the limit, short and long, against brute force over sets of shingles."""
    rng = random.Random(4)
    fresh = (f"n{k}" for k in range(10**9))
    make = lambda n: [next(fresh) for _ in range(n)]
    texts = []
    for n, own in [(8, 1), (16, 3), (24, 5), (104, 22), (104, 25), (104, 26), (364, 80), (364, 88), (364, 90), (364, 95), (364, 110), (364, 140)] * 5:
        base = make(n)
        texts += [base, base + make(own)]  # n - 4 shingles inside n - 4 + own
    for swaps in (6, 7, 8, 9, 10, 12) * 5:
        base = make(364)
        other = list(base)
        for at in rng.sample(range(5, 355, 6), swaps):
            other[at] = next(fresh)
        texts += [base, other]
    chain = make(400)
    texts += [chain[i : i + 300] for i in range(0, 100, 20)]  # ends linked by those between them only
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    want = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) / len(a | b) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    assert 60 < len(set(want)) < len(want) - 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for split_rows in (simhash.SPLIT_ROWS, 10):
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs, split_rows=split_rows).collect()} == dict(enumerate(want))


def test_kept_documents_of_a_table_against_exact_similarity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    words = {r["doc_id"]: (r["text"] or "").encode().lower().split() for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    want = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i != j and len(a & b) / len(a | b) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = {k: low if w == high else w for k, w in want.items()}
    assert {r["doc_id"] for r in simhash.keep_first(docs).collect()} == {i for i, w in want.items() if i == w}


def test_keys_of_very_many_rows(spark):
    rows = [(i, "one and the same text here") for i in range(50)] + [(i, None) for i in range(50, 90)] + [(i, f"other text {i} " * 4) for i in range(90, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for of in (simhash.near_duplicates, simhash.similar_documents):
        plain = sorted(map(tuple, of(docs).collect()))
        assert sorted(map(tuple, of(docs, hot_rows=20).collect())) == plain and len(plain) == len(rows)


def test_one_id_with_different_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, a), (3, c), (1, a), (4, None), (4, ""), (None, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(map(tuple, simhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (3, c), (4, None), (None, a)], key=str)
    assert sorted(r["component_id"] for r in simhash.similar_documents(docs).collect()) == [1, 1, 1, 1, 1, 3, 4, 4]


def test_candidates_compared_by_tree(spark):
    """Pairs at 0.8 to 0.85 and just below, chains and groups around one text: the same with whole components and with trees."""
    rng = random.Random(11)
    fresh = (f"m{k}" for k in range(10**9))
    make = lambda n: [next(fresh) for _ in range(n)]
    texts = []
    for _ in range(300):  # n - 4 shingles inside n - 4 + own
        n = rng.randint(30, 200)
        base = make(n)
        texts += [base, base + make(max(1, round((n - 4) * rng.uniform(0.17, 0.27))))]
    for width, step in ((44, 4), (44, 5), (84, 8), (84, 10)):  # links of 0.8 and more, and of less, from each to the next
        chain = make(width + 60 * step)
        texts += [chain[i * step : i * step + width] for i in range(60)]
    for _ in range(3):  # texts near one that aren't near each other
        base = make(200)
        texts.append(base)
        for k in range(30):
            own = list(base)
            for at in rng.sample(range(5, 190, 6), 4):
                own[at] = next(fresh)
            texts.append(own)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    holders = {}
    for i, x in enumerate(sets):
        for shingle in x:
            holders.setdefault(shingle, []).append(i)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in {j for shingle in a for j in holders[shingle] if j < i}:
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: find(i) for i in range(len(texts))}
    for whole in (simhash.WHOLE, 1):
        assert {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs, whole=whole).collect()} == want


def test_a_long_chain_is_compared_in_linear_work(spark):
    n = 100_000
    links = spark.range(n).selectExpr("id as tree", "id + 1 as a", "id as b").unionByName(spark.range(n).selectExpr("id + 1000000 as tree", "id + 1 as a", "id as b"))
    where = simhash.compared_in(links, 64).selectExpr("node", "explode(places) as place")
    assert where.count() == 2 * n  # each node meets the one before and the one after, once, though two buckets found them
    assert where.groupBy("place").count().where("count <> 2").isEmpty()
