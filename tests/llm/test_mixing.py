import random

from tablescape.llm import mixing


def plain_sainte_lague(weights, seats, most):
    got = [0] * len(weights)
    for _ in range(min(seats, sum(m for w, m in zip(weights, most) if w > 0))):
        i = min((i for i in range(len(weights)) if weights[i] > 0 and got[i] < most[i]), key=lambda i: (-weights[i] / (2 * got[i] + 1), i))
        got[i] += 1
    return got


def test_apportionment_equals_seat_by_seat():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 9)
        weights, most = [float(rng.choice([0, 1, 2, 5, 7.5, 11])) for _ in range(n)], [rng.randrange(0, 30) for _ in range(n)]
        seats = rng.randrange(0, 90)
        assert mixing.sainte_lague(weights, seats, most) == plain_sainte_lague(weights, seats, most)


def plain_targets(sizes, weights, ratio, most):
    out, pool = [0.0] * len(sizes), ratio * sum(sizes)
    for _ in range(10_000):
        open_ = [i for i in range(len(sizes)) if out[i] < most * sizes[i] - 1e-12]
        if pool < 1e-9 or not open_:
            break
        total, left = sum(weights[i] for i in open_), 0.0
        for i in open_:
            out[i] += pool * weights[i] / total
            if out[i] > most * sizes[i]:
                left += out[i] - most * sizes[i]
                out[i] = most * sizes[i]
        pool = left
    return out


def test_targets():
    rng = random.Random(6)
    for _ in range(50):
        sizes = [rng.randrange(0, 1000) for _ in range(rng.randrange(1, 12))]
        w = mixing.cyclic_weights(len(sizes))
        for a, b in zip(mixing.targets(sizes, w, 1.5, 2), plain_targets(sizes, w, 1.5, 2)):
            assert abs(a - b) < 1e-6


def test_mix(docs, none, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 3)
    monkeypatch.setattr(mixing, "FAN", 2)  # several levels of groups
    got = mixing.mix(docs, block=8).collect()
    assert sorted(map(str, [r["doc_id"] for r in got])) == sorted(map(str, [r["doc_id"] for r in docs.collect()]))
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect() if r["doc_id"] is not None}
    taken = {}
    for r in got:
        assert r["doc_id"] is None or r["size"] == size[r["doc_id"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        x = taken.setdefault((r["source_size"], r["target"]), [0, 0])
        x[0] += r["taken"]
    for (whole, target), (t, _) in taken.items():
        assert abs(t - target) <= 8 * 12 + 1, (whole, target, t)
    assert abs(sum(x[0] for x in taken.values()) - 1.5 * sum(r["size"] for r in got)) < 8 * 40
    again = mixing.mix(docs, block=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.op6_mix(none).count() == 0
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns and rows.count() > 0
