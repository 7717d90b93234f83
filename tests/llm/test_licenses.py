import random
import re

from tablescape.llm import licenses


def brute(text):
    """Per template the share of its shingles in the whole text."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    shingles = {" ".join(words[i : i + 5]) for i in range(len(words) - 4)}
    shares = {n: len(w & shingles) / len(w) for n, b in licenses.TEMPLATES.items() for w in [set(licenses.template_shingles(b))]}
    return {n: s for n, s in shares.items() if s >= 0.8}


def test_against_brute_force(spark, docs, none):
    rng = random.Random(3)
    filler = lambda n: " ".join(rng.choice(["lorem", "ipsum", "dolor", "the", "license"]) for _ in range(n))
    rows = []
    for i, body in enumerate(licenses.TEMPLATES.values()):
        words = body.split()
        rows.append((i, filler(rng.randrange(0, 300)) + "\n" + body + "\n" + filler(50)))
        broken = [w if k != len(words) // 2 else "changed" for k, w in enumerate(words)]
        rows.append((100 + i, filler(rng.randrange(0, 90)) + " " + " ".join(broken).upper() + " " + filler(9)))
        rows.append((200 + i, filler(30) + " " + " ".join(words[: len(words) // 2])))
        rows.append((300 + i, " ".join(words[: int(len(words) * 0.9)])))
    rows += [(r["doc_id"], r["text"]) for r in docs.collect()]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, matches string, size int").repartition(3)
    got = sorted((str(r["doc_id"]), str({m["template"]: round(m["containment"], 9) for m in r["matches"]})) for r in licenses.scan(df).collect())
    want = sorted((str(i), str({k: round(v, 9) for k, v in sorted(brute(t).items())})) for i, t in rows)
    assert got == want
    assert sum(w[1] != "{}" for w in want) >= 2 * len(licenses.TEMPLATES)
    assert licenses.op4_licenses(none).count() == 0


def test_inserted_words_at_every_offset(spark):
    """Words put in the middle, or at two places, of a template that the text then still holds for the most part."""
    rows, want = [], {}
    for name, body in licenses.TEMPLATES.items():
        words, wanted = re.findall(r"[^\W_]+", body.lower()), set(licenses.template_shingles(body))
        for extra in (10, 20, 40, 400):
            for cuts in ([len(words) // 2], [len(words) // 3, 2 * len(words) // 3]):
                text = list(words)
                for c in reversed(cuts):
                    text[c:c] = [f"w{c}x{k}" for k in range(extra)]
                for offset in range(24):
                    full = [f"y{k}" for k in range(offset)] + text
                    share = len(wanted & {" ".join(full[i : i + 5]) for i in range(len(full) - 4)}) / len(wanted)
                    rows.append((len(rows), " ".join(full)))
                    want[len(rows) - 1, name] = round(share, 9) if share >= 0.8 else None
    got = {(r["doc_id"], m["template"]): round(m["containment"], 9) for r in licenses.scan(spark.createDataFrame(rows, "doc_id int, text string").repartition(4)).collect() for m in r["matches"]}
    assert {k: got.get(k) for k in want} == want
    assert sum(v is not None for v in want.values()) > 800


def test_no_python_in_the_plan(docs):
    plan = licenses.op4_licenses(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
