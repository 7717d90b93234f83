"""Token counts: pieces counted once a distinct pre-token, joined to the documents' pre-token frequencies and summed."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.llm import lexicon
from tablescape.llm.common import arrow_schema, rows_of
from tablescape.llm.tokenids import piece_ids

#: Fixed by the tokenizer family: how byte-level BPE cuts text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Beyond these characters Unicode versions can differ on letters; such texts are cut by the library itself.
SETTLED = re.compile("[^\x00-ԯ‐-‧‰-⁞€]")

_LOADED: dict[str, tuple] = {}


def _tools(path: str):
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        _LOADED[path] = t, regex.compile(PRE_TOKEN), re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None, frozenset(special)
    return _LOADED[path]


def pre_tokens(text: str, path: str) -> list[str]:
    """The text's pre-tokens, and its special strings as terms of their own."""
    tokenizer, pattern, special, names = _tools(path)
    parts = special.split(text) if special and special.search(text) else [text]
    out: list[str] = []
    for part in parts:
        if part in names:
            out.append(part)
        elif SETTLED.search(part):
            out += [part[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        else:
            out += pattern.findall(part)
    return out


def token_counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_tokens): UTF-8 bytes and tokens of every whole text, without added special tokens.

    For tokenizers of byte-level pre-tokens. Special strings in a text count
    as the library counts them. Null and empty texts have 0 of both; repeated
    rows and null ids stay; extra columns are ignored; an empty table gives an
    empty result.
    """
    def split(body: bytes) -> list[bytes]:
        return [x.encode("utf-8", "surrogatepass") for x in pre_tokens(body.decode("utf-8", "replace"), path)]

    def value(terms, *_):
        tokenizer, _, _, special = _tools(path)
        names = (t.decode("utf-8", "replace") for t in terms)
        return np.array([1 if t in special else len(piece_ids(tokenizer, t)) for t in names], np.int64), None, None

    table = lexicon.blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), split, bags=True)
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, n_bytes bigint, n_tokens bigint"
    wanted = arrow_schema(schema)

    def run(batches):
        for batch in rows_of(batches, 1):
            row = batch.to_pylist()[0]
            codes, freqs, ends = lexicon.codes_of(row)
            running = np.concatenate([[0], np.cumsum(lexicon.numbers_of(row)[codes] * freqs)])
            totals = np.diff(np.concatenate([[0], running[ends]]))
            yield pa.RecordBatch.from_pydict({"doc_id": row["doc_ids"], "n_bytes": row["n_bytes"], "n_tokens": totals}, schema=wanted)

    joined = lexicon.with_values(table, lexicon.valued(table, value))
    return joined.select("doc_ids", "n_bytes", "ends", "codes", "freqs", "n_terms", "parts").mapInArrow(run, schema)


def op2_token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    return token_counts(docs, path).withColumn("over_limit", F.col("n_tokens") > limit)
