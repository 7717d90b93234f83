"""Fill-in-middle against a plain version, and its inverse."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tablescape.llm import fim


def plain(i, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h, n = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)], len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b, f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_against_plain_version(spark, docs, none, monkeypatch, step):
    if step > 1:  # long texts byte by byte take too long
        monkeypatch.setattr(fim, "STEP", step)
    extra = [(i + 2000, t) for i, t in enumerate(["a<P>b", "<S>", "x<M", "<<P", "é" * 9, "😀 ß 😀", "<", "P>", "z"] * 12)] + [(None, "<P>")]
    more = docs.unionByName(spark.createDataFrame(extra, "doc_id bigint, text string"), allowMissingColumns=True).withColumnRenamed("rank", "fim_form")
    made = fim.fill_in_middle(more)
    assert made.columns == [*more.columns, "fim_n", "fim_form_", "fim_low", "fim_high", "fim_output"]
    rows = fim.restored(made, form="fim_form_").collect()
    assert len(rows) == more.count() and {r["fim_form_"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r["fim_n"], r["fim_form_"], r["fim_low"], r["fim_high"], r["fim_output"]) == plain(r["doc_id"], r["text"])
        assert r["fim_restored"] == (r["text"] or "")
    assert sorted(str(r["_extra"]) for r in rows) == sorted(str(r["_extra"]) for r in more.collect())
    got = fim.op13_fill_in_middle(docs).collect()
    assert sorted((str(r["doc_id"]), r["restored_sha256"]) for r in got) == sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert fim.op13_fill_in_middle(none).count() == 0


def test_scatter_and_gather_in_steps(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aé😀 <") for _ in range(rng.randrange(0, 30))) for _ in range(60)]
    form = np.array([rng.randrange(3) if t else 0 for t in texts])
    cuts = np.array([sorted(rng.randrange(len(t) + 1) for _ in range(2)) for t in texts])
    for step in (1, 2, 5, 64, 1 << 20):
        monkeypatch.setattr(fim, "STEP", step)
        for at in (0, 1, 17):
            out = fim.scattered(pa.array(texts)[at:], form[at:], cuts[at:, 0], cuts[at:, 1])
            for o, t, f, (a, b) in zip(out.to_pylist(), texts[at:], form[at:], cuts[at:]):
                p, m, s = t[:a], t[a:b], t[b:]
                assert o == (t, f"<P>{p}<S>{s}<M>{m}", f"<S>{s}<P>{p}<M>{m}")[f]
            assert fim.gathered(out, form[at:]).to_pylist() == texts[at:]
    assert fim.scattered(pa.array([], pa.string()), form[:0], cuts[:0, 0], cuts[:0, 1]).to_pylist() == []
