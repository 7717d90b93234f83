import random
from collections import defaultdict

import numpy as np
import xxhash

from tablescape.llm import simhash


def brute_fp(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_against_brute_force(docs):
    rows = docs.collect()
    fps = [brute_fp(r["text"]) for r in rows]
    for radius in (3, 9):
        comp = components(fps, radius)
        least = defaultdict(list)
        for r, c in zip(rows, comp):
            least[c].append(r["doc_id"])
        want = sorted((str(r["doc_id"]), f, min((x for x in least[c] if x is not None), default=None)) for r, f, c in zip(rows, fps, comp))
        got = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(docs, radius).collect())
        assert got == want


def test_contract_columns_and_empty(docs, none):
    out = simhash.op3_simhash(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in out.collect())
    assert simhash.op3_simhash(none).count() == 0


def test_random_fingerprints_in_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "SALT", 2)
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(c) ^ int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64))) for c in centres for k in rng.integers(1, 5, 30)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp bigint")
    from tablescape.operators.components import connected_components

    got = {r["node"] & (2**64 - 1): r["component"] for r in connected_components(simhash.linking_edges(df, 3)).collect()}
    comp = components(fps, 3)
    by = defaultdict(set)
    for f, c in zip(fps, comp):
        by[c].add(f)
    want = {frozenset(v) for v in by.values() if len(v) > 1}
    have = defaultdict(set)
    for f, c in got.items():
        have[c].add(f)
    assert {frozenset(v) for v in have.values()} == want


def jaccard(a, b):
    x, y = (w if (w := (t or "").encode().lower().split()) else [] for t in (a, b))
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (x, y))
    return len(x & y) / len(x | y) if x | y else 1.0


def kept_by_brute_force(rows):
    """doc_ids that stay of [(doc_id, text)], nulls last: one a group of 3-bit links, and of groups with a wider link of texts that share 0.8 of their shingles."""
    texts = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    fps = [(brute_fp(t), brute_fp(t, 1)) for _, t in texts]
    group, first = components([f for f, _ in fps], 3), {}
    for i, (f, _) in enumerate(fps):
        first.setdefault(f, i)
    for i, (s, w) in enumerate(fps):
        for j in range(i):
            if group[i] != group[j] and (s ^ fps[j][0]).bit_count() <= simhash.NEAR[1] and (w ^ fps[j][1]).bit_count() <= simhash.NEAR[0] and jaccard(texts[first[s]][1], texts[first[fps[j][0]]][1]) >= 0.8:
                old, new = group[i], group[j]
                group = [new if x == old else x for x in group]
    seen = {}
    for i, g in enumerate(group):
        seen.setdefault(g, texts[i][0])
    return list(seen.values())


def test_keep_first(docs, none):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept_by_brute_force([(r["doc_id"], r["text"]) for r in docs.collect()]))) == sorted(str(r["doc_id"]) for r in kept.collect())
    assert simhash.keep_first(docs, near=None).count() == len({r["component_id"] for r in simhash.near_duplicates(docs).collect()})
    assert simhash.keep_first(none).count() == 0


def test_candidates_are_compared_before_they_go(spark):
    """Copies of which a few words are other ones, and texts that only share their frequent words: neither set chose ``NEAR``."""
    rng = random.Random(77)
    vocabulary = [f"v{i}" for i in range(900)]
    weights = [1 / (i + 1) ** 1.3 for i in range(900)]
    rows, copies = [], 0
    for i in range(90):
        words = rng.choices(vocabulary, weights, k=rng.randrange(120, 400))
        rows.append((10 * i, " ".join(words)))
        if i % 2 == 0:
            for at in rng.sample(range(len(words)), max(1, len(words) // 60)):
                words[at] = rng.choice(vocabulary)
            rows.append((10 * i + 1, " ".join(words)))
            copies += 1
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(df).collect()}
    want = set(kept_by_brute_force(rows))
    assert want <= kept and len(kept - want) <= 0.05 * len(want)  # only the nearest wider links are compared
    text = dict(rows)
    narrow = {r["doc_id"] for r in simhash.keep_first(df, near=None).collect()}
    gone = narrow - kept
    assert gone and all(any(jaccard(text[g], t) >= 0.8 for i, t in rows if i < g) for g in gone)  # precision of the wider links: 1
    true = [i for i, _ in rows if i % 10 and jaccard(text[i], text[i - 1]) >= 0.8]
    assert sum(i not in kept for i in true) >= 0.9 * len(true) and len(true) > copies / 2


def test_nearest_forest():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6, dtype=np.uint64)
    noise = lambda n, k: np.array([int(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64))) for _ in range(n)], np.uint64)
    a, b = np.repeat(base, 8) ^ noise(48, 3), np.repeat(base, 7) ^ noise(42, 3)
    wa, wb = np.repeat(base, 8) ^ noise(48, 1), np.repeat(base, 7) ^ noise(42, 1)
    for x, y, wx, wy in ((a, b, wa, wb), (a, a, wa, wa), (a[:0], b, wa[:0], wb), (a[:1], b[8:9], wa[:1], wb[8:9])):
        u, v = simhash.nearest_forest(x, y, 6, (wx, wy, 3)) if len(x) else (x, x)
        links = {(int(p), int(q)): (int(p) ^ int(q)).bit_count() + (int(s) ^ int(t)).bit_count() for p, s in zip(x, wx) for q, t in zip(y, wy) if p != q and (int(p) ^ int(q)).bit_count() <= 6 and (int(s) ^ int(t)).bit_count() <= 3}
        got = list(zip(u.tolist(), v.tolist()))
        assert all(e in links or e[::-1] in links for e in got)
        nodes = sorted({n for e in links for n in e})
        at = {n: i for i, n in enumerate(nodes)}

        def parts(edges):
            root = list(range(len(nodes)))
            for p, q in edges:
                p, q = root[at[p]], root[at[q]]
                root = [min(p, q) if r in (p, q) else r for r in root]
            return root

        assert parts(got) == parts(links) and len(got) == len(nodes) - len(set(parts(links)))
        for n in nodes:  # a nearest link of every node is in it, up to ties
            best = min(d for e, d in links.items() if n in e)
            assert any(links.get(e, links.get(e[::-1])) == best for e in got if n in e)


def test_copies_with_changed_words_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "SALT", 2)
    rng = random.Random(5)
    # frequent and rare words, as in prose
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    texts, pairs = [], []
    for i in range(150):
        words = rng.choices(vocabulary, weights, k=rng.randrange(150, 500))
        texts.append(" ".join(words))
        if i % 3 == 0:
            for at in rng.sample(range(len(words)), len(words) // 70):
                words[at] = rng.choice(vocabulary)
            pairs.append((len(texts) - 1, len(texts)))
            texts.append(" ".join(words))
    fps = [(brute_fp(t), brute_fp(t, 1)) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (s, w) in enumerate(fps):
        for j in range(i):
            bits = (s ^ fps[j][0]).bit_count()
            if bits <= 3 or (bits <= simhash.NEAR[1] and (w ^ fps[j][1]).bit_count() <= simhash.NEAR[0]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, near=simhash.NEAR).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert len(set(got.values())) >= 150
    narrow = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert sum(narrow[a] == narrow[b] for a, b in pairs) < sum(got[a] == got[b] for a, b in pairs)
