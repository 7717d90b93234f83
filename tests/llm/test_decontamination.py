import hashlib
import random
import re

import numpy as np

from tablescape.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = []
    for i, t in items:
        w = words(t)
        if w:
            wins += [(w[a : a + 13], i) for a in range(max(1, len(w) - 12))]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for win, i in wins:
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    ids |= {str(i)} - {"None"}
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((str(d), len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def tables(spark):
    rng = random.Random(8)
    vocab = ["a", "b", "c", "Dé", "e5", "ß"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 13, 14, 20, 30]))) for i in range(1, 12)] + [(3, text(15)), (20, None), (21, ""), (22, "!!"), (None, text(4)), (23, "unique words only here")]
    docs = [(i, text(rng.randrange(0, 60))) for i in range(40)] + [(100, None), (101, ""), (None, "x " + items[4][1] + " y"), (102, text(3000) + " " + items[5][1])]
    docs += [(103, "A. " * 40), docs[3], docs[3]]
    extra = [(*r, "clash", 1) for r in docs]
    return docs, items, spark.createDataFrame(extra, "doc_id bigint, text string, items string, n_words int").repartition(3), spark.createDataFrame(items, "item_id bigint, text string")


def got(df):
    return sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect())


def test_against_brute_force_in_one_pass_and_in_many(spark, monkeypatch):
    docs, items, d, b = tables(spark)
    want = brute(docs, items)
    assert got(dc.op7_decontaminate(d, b)) == want
    monkeypatch.setattr(dc, "PASS_WORDS", 30)
    monkeypatch.setattr(dc, "ROW_BYTES", 200)
    assert got(dc.op7_decontaminate(d, b)) == want


def test_bulk_search_is_the_search_one_by_one():
    rng = random.Random(4)
    text = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(4000)]
    at = {}
    for i, w in enumerate(text):
        at.setdefault(w, []).append(i)
    terms = sorted(at)
    postings = dc.Postings(terms, np.cumsum([len(at[t]) for t in terms]).astype("<i8").tobytes(), np.concatenate([at[t] for t in terms]).astype("<i4").tobytes())
    asked = {tuple(text[i : i + n]): [i] for i, n in ((rng.randrange(3980), rng.choice([1, 2, 5, 13])) for _ in range(200))}
    asked[(b"a", b"zz")] = [1]
    asked[tuple(text[-5:])] = [2]
    got = {}
    for number, places in postings.all_of(dc.Phrases(asked, 13)):
        for p, x in zip(number.tolist(), places.tolist()):
            got.setdefault(p, []).append(x)
    for p, words in enumerate(asked):
        assert sorted(got.get(p, [])) == postings.phrase(words).tolist(), words


def test_empty_tables(spark):
    docs, items, d, b = tables(spark)
    assert dc.op7_decontaminate(d.where("false"), b).count() == 0
    assert all(x[2] == 0 and not x[5] for x in got(dc.op7_decontaminate(d, b.where("false"))))
    kept = dc.clean_documents(d, b)
    assert kept.columns == d.columns
    assert kept.count() == sum(not x[5] for x in brute(docs, items))


def test_search_by_phrase_and_proximity(spark):
    d = spark.createDataFrame([(1, "the quick brown fox jumps"), (2, "the brown quick fox jumps"), (3, "fox"), (4, None)], "doc_id bigint, text string")
    hits = {(r["doc_id"], r["kind"]) for r in dc.search(dc.build_index(d), {"p": "Quick, brown fox"}, slop=2).collect()}
    assert hits == {(1, "phrase"), (2, "proximity")}
