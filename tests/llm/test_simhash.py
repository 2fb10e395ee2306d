import random

import xxhash

from assaykit.llm import simhash


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(items):
    """items: (id, fingerprint); union of every pair at distance 3 or less."""
    root = {i: i for i in range(len(items))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(items)):
        for b in range(a):
            if (items[a][1] ^ items[b][1]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for a, (doc, _) in enumerate(items):
        least[find(a)] = min(least.get(find(a), doc), doc)
    return sorted((doc, least[find(a)]) for a, (doc, _) in enumerate(items))


def test_fingerprint_of_small_texts():
    for text in (None, "", " \t", "One", "one two", "A b C d e f g a b C", "é É ß\x0bx\x1cy  z", "a b c d " * 50):
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint("ONE Two") == simhash.fingerprint("one  two\n")


def test_links_against_every_pair(spark):
    rng = random.Random(5)
    items = []
    for _ in range(40):  # chains, crowds and far ones
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 3, 12])):
            items.append(at)
            for bit in rng.sample(range(64), rng.choice([0, 1, 2, 3, 3, 4])):
                at ^= 1 << bit
    base = rng.getrandbits(64)
    items += [base ^ sum(1 << b for b in rng.sample(range(64), k)) for k in (1, 2, 3) for _ in range(25)]
    items += [base ^ (7 << s) for s in (0, 5, 13, 61)] + [0, 0, 7, 2**64 - 1]
    rows = list(enumerate(items))
    fps = spark.createDataFrame([(d, simhash._signed(x)) for d, x in rows], "doc_id bigint, fp bigint")
    links = simhash.near_links(fps).collect()
    assert all(((r.u ^ r.v) & (2**64 - 1)).bit_count() <= 3 for r in links)
    roots = {r.node: r.root for r in simhash.connected_components(simhash.near_links(fps)).collect()}
    groups = {}
    for d, x in rows:
        groups.setdefault(roots.get(simhash._signed(x), simhash._signed(x)), []).append(d)
    assert sorted((d, min(g)) for g in groups.values() for d in g) == plain_components(rows)


def test_near_duplicates_with_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text, "x"), (3, text, "y"), (3, text, "y"), (None, text, None), (9, None, "z"), (8, "", "z"), (7, "other words", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (7, 7), (8, 8), (9, 8)]
    assert simhash.near_duplicates(df.where("doc_id > 99")).count() == 0


def test_query_against_every_pair(spark, sf_dir):
    from assaykit.llm.queries import op4_simhash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expect = {r.doc_id: plain_fingerprint(r.text) for r in docs}
    got = op4_simhash(spark, sf_dir).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == expect
    assert sorted((r.doc_id, r.component_id) for r in got) == plain_components(sorted(expect.items()))


def gram_set(text, size=5):
    words = text.lower().split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_keep_first_against_every_pair_at_point_eight(spark):
    rng = random.Random(11)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([80, 200, 400]))]
        texts += [" ".join(base), edited(rng, base, rng.choice([1, 1, 2, 3, 5, 9]) * len(base) // 200 + 1), edited(rng, base, len(base) // 10)]
    base = [f"v{rng.randrange(5000)}" for _ in range(200)]
    texts += [" ".join(base)] + [edited(rng, base, 3) for _ in range(70)]  # a crowd
    rng.shuffle(texts)
    sets = [gram_set(t) for t in texts]
    true = {(a, b) for a in range(len(texts)) for b in range(a) if alike(sets[a], sets[b])}
    far = sum((simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 3 for a, b in true)
    assert far > 0.5 * len(true)  # what a radius of 3 doesn't reach
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = simhash.near_copies(docs).collect()
    root = {r.doc_id: r.component for r in rows}
    assert sum(root[a] == root[b] for a, b in true) >= 0.97 * len(true)
    groups = list(range(len(texts)))
    for _ in groups:  # no more is connected than all true links connect
        changed = [(a, b) for a, b in true if groups[a] != groups[b]]
        for a, b in changed:
            groups[a] = groups[b] = min(groups[a], groups[b])
        if not changed:
            break
    assert all(len({groups[d] for d in root if root[d] == r}) == 1 for r in set(root.values()))
    kept = [r.doc_id for r in simhash.keep_first(docs).collect()]
    assert sorted(kept) == sorted(min(d for d in root if root[d] == r) for r in set(root.values()))


def random_prints(rng, n, crowd):
    """n fingerprints, of which `crowd` are within some bits of one."""
    import numpy as np

    prints = rng.integers(0, 2**64, (n, simhash.WORDS), dtype=np.uint64)
    for k in range(crowd):
        prints[k] = prints[0]
        for bit in rng.integers(0, 64 * simhash.WORDS, k % 12).tolist():
            prints[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    return prints


def test_crowds_are_linked_to_leaders():
    import numpy as np

    prints = random_prints(np.random.default_rng(2), 300, 200)
    u, v = (np.concatenate(x) for x in simhash._led(prints))
    distance = np.bitwise_count(prints[u] ^ prints[v]).sum(axis=1)
    assert (distance <= simhash.FAR).all() and len(u) < 2 * len(prints)
    every = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= simhash.FAR
    linked = set(u.tolist()) | set(v.tolist())
    assert linked == set(np.nonzero(every.sum(axis=1) > 1)[0].tolist())


def test_pairs_do_not_depend_on_how_groups_are_dealt(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    prints = np.concatenate([random_prints(rng, 3, 3) for _ in range(600)])
    rows = [(int(k), bytes(p.astype("<u8").tobytes())) for k, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node bigint, prints binary").repartition(4)
    found = [sorted(map(tuple, simhash._candidates(nodes, len(rows), most).collect())) for most in (1 << 20, 8)]
    assert found[0] and found[0] == found[1]


def test_links_of_a_crowd_follow_its_size(spark):
    import numpy as np

    for n in (500, 2000):
        prints = random_prints(np.random.default_rng(4), n, n)
        rows = [(int(k), bytes(p.astype("<u8").tobytes())) for k, p in enumerate(prints)]
        found = simhash._candidates(spark.createDataFrame(rows, "node bigint, prints binary"), n).count()
        assert n - 1 <= found <= 2 * simhash.TABLES * n  # all pairs are n * n / 2


def pairs_in_a_crowd(n):
    """2 n texts that all have some 0.74 of their runs in common, so that none is near a leader; each has one near copy."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [edited(rng, base, 6) for _ in range(n)]
    return [x for t in texts for x in (t, edited(rng, t.split(), 1))]


def test_pairs_without_a_leader_in_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TABLES", 3)
    monkeypatch.setattr(simhash, "EQUAL", 0)
    texts = pairs_in_a_crowd(60)
    sets = [gram_set(t) for t in texts]
    assert all(alike(sets[a], sets[a + 1]) for a in range(0, len(texts), 2))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    root = {r.doc_id: r.component for r in simhash.near_copies(docs).collect()}
    groups = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if groups[a] != groups[b] and alike(sets[a], sets[b]):
                groups = [groups[b] if g == groups[a] else g for g in groups]
    assert all(root[a] == root[b] for a in range(len(texts)) for b in range(a) if groups[a] == groups[b])
    assert len(set(root.values())) == len(set(groups)) > len(texts) // 3


def test_clusters_are_searched_as_every_pair(spark):
    """Blocks of any size find the components of every pair, of texts with and without shingles of their own."""
    import numpy as np

    rng = np.random.default_rng(6)
    cores = [rng.choice(10**6, 40, replace=False) for _ in range(6)]
    sets = [np.unique(np.append(cores[k % 6][rng.random(40) < 0.93], rng.choice(10**6, rng.integers(0, 4)))).astype("<u4") for k in range(150)] + [np.zeros(0, "<u4")]
    groups = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                groups = [groups[b] if g == groups[a] else g for g in groups]
    want = {frozenset(k for k, g in enumerate(groups) if g == x) for x in set(groups)}
    grams = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "node bigint, grams binary")
    clusters = spark.createDataFrame([(0, k, k) for k in range(len(sets))], "cluster bigint, node bigint, root bigint")
    for most in (4096, 20):
        found = simhash._between(clusters, grams, 0.8, most)
        least = {r.node: r.root for r in simhash.connected_components(found).collect()}
        assert {frozenset(k for k in range(len(sets)) if least.get(k, k) == x) for x in {least.get(k, k) for k in range(len(sets))}} == want


def test_ties_connect_all_that_is_near():
    import numpy as np

    rng = np.random.default_rng(8)
    prints = random_prints(rng, 400, 1)
    for k in range(1, 300):  # chains whose ends are far from each other
        prints[k] = prints[k - 1] if k % 20 else prints[k]
        for bit in rng.integers(0, 64 * simhash.WORDS, 30).tolist():
            prints[k, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    near = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2) <= simhash.FAR
    u, v = np.nonzero(near)
    assert (simhash._tied(prints, *simhash._led(prints)) == simhash._forest(400, u, v)).all()


def test_keep_first_with_null_and_repeated_ids(spark):
    a, b, c = "one text about the first thing here", "quite another text with other words", "the third of the texts has its own"
    rows = [(None, a, 1), (None, b, 2), (4, c, 3), (4, c, 3), (4, "what else stands under the id of four", 4), (9, a.upper() + " ", 5), (6, None, 6), (7, " ", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, __n int")
    got = simhash.keep_first(df)
    assert got.columns == df.columns and sorted(r["__n"] for r in got.collect()) == [2, 3, 4, 5, 6]
    assert simhash.keep_first(df.limit(0)).count() == 0
