import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablescape.llm import lexicon, tokencount, tokenids

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def odd_texts(n=300, seed=9):
    """Texts of characters from all over Unicode, odd white space, special strings and contractions."""
    rng = random.Random(seed)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "it's", "I'LL", " 'd", "  ", "\n\n ", "\t", "\x0b", "\x1c", "\x85", " ", " ", "　", "12345", "é", "é", "≠", "Σ", "ΑΣ", "İ", "ß", "ﬁ", "Ⅷ", "²", "​", "!?.", "word", "Word", " a", "日本", "\U0001f600", "กำ", "'s"]
    out = []
    for _ in range(n):
        parts = [rng.choice(pieces) if rng.random() < 0.7 else chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(rng.randrange(1, 25))]
        out.append("".join(parts))
    return out


def test_pre_tokens_are_the_librarys():
    t = Tokenizer.from_file(BYTE)
    for text in odd_texts():
        got = sum(len(t.encode(x, add_special_tokens=False).ids) for x in tokencount.pre_tokens(text, BYTE))
        assert got == len(t.encode(text, add_special_tokens=False).ids), repr(text)
        assert "".join(tokencount.pre_tokens(text, BYTE)) == text


def test_settled_characters_are_cut_alike():
    t, pattern = Tokenizer.from_file(BYTE), tokencount._tools(BYTE)[1]
    for code in range(0x530):
        for text in (f"a{chr(code)}b", f" {chr(code)}{chr(code)} 1", f"{chr(code)} {chr(code)}'s"):
            assert pattern.findall(text) == [text[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(text)], repr(text)


def test_token_counts(spark, docs, none, monkeypatch):
    rows = [(1000 + i, t) for i, t in enumerate(odd_texts(120))] + [(r["doc_id"], r["text"]) for r in docs.collect()]
    t = Tokenizer.from_file(BYTE)
    want = sorted((str(i), len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 1024) for i, x in rows)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, n_tokens string, terms int").repartition(3)
    for size in (lexicon.BLOCK_BYTES, 700):
        monkeypatch.setattr(lexicon, "BLOCK_BYTES", size)
        monkeypatch.setattr(lexicon, "TASK_TERMS", size // 7)
        got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.op2_token_counts(df, BYTE).collect())
        assert got == want
    assert tokencount.op2_token_counts(none, BYTE).count() == 0


@pytest.mark.parametrize("width", [1, 3, 7, 8, 13, 16, 17, 31, 32])
def test_packing_round_trip(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 7, 1000, 70_000):
        ids = rng.integers(0, 2**width, n, dtype=np.uint64).astype("<u4")
        body = tokenids.pack(ids, width)
        assert len(body) == -(-n * width // 8)
        assert (tokenids.unpack(body, width, 0, n) == ids).all()
        a, b = n // 3, n - n // 5
        assert (tokenids.unpack(body, width, a, b) == ids[a:b]).all()


def test_ids_of_any_type_in_order(spark, monkeypatch):
    monkeypatch.setattr(tokenids, "PART_DOCS", 20)
    rows = [(f"id {i * 37 % 500:05d}", f"text {i} and more", i) for i in range(500)] + [(None, "no id", 0), ("id 00001", "again", 1)]
    df = spark.createDataFrame(rows, "doc_id string, text string, n int").repartition(3)
    for key in ("doc_id", "n"):
        docs = df.select(F.col(key).alias("doc_id"), "text") if key == "doc_id" else df.select(F.to_date(F.lit("2020-01-01")).alias("d"), "n", "text").select(F.date_add("d", F.col("n")).alias("doc_id"), "text")
        got = tokenids.op9_token_ids(docs, WORD).orderBy("start").collect()
        keys = [r["doc_id"] for r in got]
        assert len(got) == len(rows) and keys == sorted(keys, key=lambda k: (k is not None, k or keys[-1]))
        assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()


def test_small_vocabulary(spark, tmp_path):
    from tokenizers import models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "c": 2, "[UNK]": 3, "end": 4}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    path = str(tmp_path / "small.json")
    t.save(path)
    blocks, width = tokenids.write_packed(spark.createDataFrame([(1, "a b c"), (2, None), (3, "c zz")], "doc_id int, text string"), path, end_id=4)
    assert width == 3
    assert {r["doc_id"]: r["ids"] for r in tokenids.documents_of(blocks).collect()} == {1: [0, 1, 2, 4], 2: [4], 3: [2, 3, 4]}


def want_ids(text):
    return [*Tokenizer.from_file(WORD).encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_gives_the_librarys_ids():
    t, enc = Tokenizer.from_file(WORD), tokenids.Encoder(WORD, memory=50)
    for text in odd_texts(400, 10):
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_token_ids_round_trip(spark, docs, none):
    rows = [(2000 - i, t) for i, t in enumerate(odd_texts(60))] + [(r["doc_id"], r["text"]) for r in docs.collect()]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, start string, part int").repartition(3)
    t = Tokenizer.from_file(WORD)
    blocks, width = tokenids.write_packed(df, WORD, block_ids=500)
    assert width == 16
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenids.read_packed(blocks).orderBy("start").collect()]
    keys = [g[0] for g in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    at = 0
    for _, start, n, _ in got:
        assert start == at
        at += n
    want = sorted((str(i), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, x in rows for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 1]])
    assert sorted((str(i), n, c) for i, _, n, c in got) == want
    full = {r["doc_id"]: r["ids"] for r in tokenids.documents_of(blocks).where("doc_id >= 1990").collect()}
    assert all(full[i] == want_ids(x) for i, x in rows if i is not None and i >= 1990)
    assert tokenids.op9_token_ids(none, WORD).count() == 0


def test_ids_at_the_driver_are_bounded(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id as doc_id", "concat('word ', id) as text").repartition(5)
    plain = sorted(map(str, tokenids.op9_token_ids(df, WORD).collect()))
    for most in (1, 4, 50):
        monkeypatch.setattr(tokenids, "PART_DOCS", 10)
        monkeypatch.setattr(tokenids, "MOST_PARTS", most)
        blocks, _ = tokenids.write_packed(df, WORD)
        assert blocks.select("part").distinct().count() <= most
        assert sorted(map(str, tokenids.read_packed(blocks).collect())) == plain
