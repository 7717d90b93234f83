"""Token ids in fixed-width bit packing.

File format (a Parquet table, one row a block): ``block`` (number in file
order), ``width`` (bits an id), ``n_ids``, ``payload`` (ids of consecutive
documents, each id in ``width`` bits, least significant bit first, padded to
whole bytes), ``doc_ids`` and ``ends`` (each document's end in ids). Id i of a
block stands at bit i * width, so any document can be unpacked alone. Blocks
in order hold the documents in ascending doc_id order, nulls first.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablescape.llm.common import arrow_map, arrow_schema, rows_of
from tablescape.session import stage

#: Ids in a block, about; documents in a part of the file, about; sampled ids for each bound between parts; parts at most, beyond which they grow.
BLOCK_IDS, PART_DOCS, PART_IDS, MOST_PARTS = 1 << 18, 2048, 16, 1 << 16
#: Chunks that a task's memory of encoded chunks holds in each of two generations.
MEMORY = 500_000


def pack(ids: np.ndarray, width: int) -> bytes:
    """Each id in ``width`` bits, least significant bit first."""
    ids = np.ascontiguousarray(ids, "<u4")
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # whole bytes: 2^16 ids fill them at any width
        bits = np.unpackbits(ids[at : at + (1 << 16)].view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, width: int, first: int, past: int) -> np.ndarray:
    """Ids ``first`` to ``past`` of a block."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", past - first, first * width // 8).astype("<u4")
    skip = first * width
    part = np.frombuffer(payload, np.uint8)[skip // 8 : -(-past * width // 8)]
    bits = np.unpackbits(part, bitorder="little")[skip % 8 : skip % 8 + (past - first) * width].reshape(-1, width)
    full = np.zeros((len(bits), 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full, axis=1, bitorder="little").view("<u4")[:, 0]


#: What byte-level tokenizers write for each byte: printable ones stand for themselves, the others for the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = dict(zip([b for b in range(256) if b not in _PRINTED], range(256, 512)))
#: A lower-case word of ASCII and Latin-1 letters and the punctuation after it: two pre-tokens, whatever the normaliser does.
PLAIN = re.compile("([a-zß-öø-ÿ]+)([.,;:!?|$&%*#]*)")


def piece_ids(tokenizer, pre_token: str) -> list[int]:
    """Ids of one pre-token by the library's model, without its text pipeline; for byte-level tokenizers."""
    if not (pre_token.isascii() and pre_token.isalpha()):  # ASCII letters stand for themselves
        pre_token = pre_token.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_LETTERS)
    return [t.id for t in tokenizer.model.tokenize(pre_token)]


class Encoder:
    """Ids of whole texts by the tokenizers library, which sees each distinct chunk once as long as it is remembered.

    For tokenizers that drop white space, normalise within white space and
    never merge across it: a text's ids are those of its chunks between ASCII
    white space. Chunks are lower-cased (A-Z) first for tokenizers that
    do so themselves, unless a text may hold a special string, which is matched
    before that.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.fold = "Lowercase" in str(self.tokenizer.normalizer)
        self.memory, self.new, self.old = memory, {}, {}

    def _learn(self, chunks: list[bytes]) -> None:
        rest = []
        for c in chunks:
            plain = PLAIN.fullmatch(c.decode("utf-8", "replace"))
            if plain is None:
                rest.append(c)
                continue
            word, marks = plain.groups()
            ids = self._part(word)
            self.new[c] = ids + self._part(marks) if marks else ids
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for c, e in zip(some, self.tokenizer.encode_batch_fast([c.decode("utf-8", "replace") for c in some], add_special_tokens=False)):
                self.new[c] = np.array(e.ids, "<u4").tobytes()

    def _part(self, pre_token: str) -> bytes:
        key = pre_token.encode()
        ids = self.new.get(key) or self.old.get(key)
        if ids is None:
            found = piece_ids(self.tokenizer, pre_token)
            ids = struct.pack(f"<{len(found)}I", *found)
        self.new[key] = ids
        return ids

    def distinct(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of chunks that are not seen again; nothing is remembered."""
        names = [c.decode("utf-8", "replace") for c in chunks]
        out = [None] * len(names)
        odd = []
        for i, name in enumerate(names):
            plain = PLAIN.fullmatch(name)
            if plain is None:
                odd.append(i)
            else:
                word, marks = plain.groups()
                out[i] = piece_ids(self.tokenizer, word) + (piece_ids(self.tokenizer, marks) if marks else [])
        for at in range(0, len(odd), 4096):
            some = odd[at : at + 4096]
            for i, e in zip(some, self.tokenizer.encode_batch_fast([names[i] for i in some], add_special_tokens=False)):
                out[i] = e.ids
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        data = text.encode("utf-8", "surrogatepass")
        chunks = (data.lower() if self.fold and b"<|" not in data else data).split()
        out = list(map(self.new.get, chunks))
        if None in out:
            missing = []
            for c in dict.fromkeys(c for c, ids in zip(chunks, out) if ids is None):
                ids = self.old.get(c)
                if ids is None:
                    missing.append(c)
                else:
                    self.new[c] = ids
            self._learn(missing)
            out = list(map(self.new.__getitem__, chunks))
            if len(self.new) > self.memory:
                self.old, self.new = self.new, {}
        return b"".join(out)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_width(path: str) -> int:
    """Bits that hold every id of the vocabulary."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return max(1, int(max(vocab.values())).bit_length())


def write_packed(docs: DataFrame, path: str, end_id: int | None = 1, text: str = "text", doc_id: str = "doc_id", block_ids: int = BLOCK_IDS) -> tuple[DataFrame, int]:
    """Encode every whole text and write the packed blocks; (the written table, bits an id).

    Null and empty texts give the end id alone. Documents are dealt to parts
    of about ``PART_DOCS`` by ranges of doc_id, of any type that Spark sorts
    (bounds from a sample of the id column alone, so texts are encoded once;
    about ``PART_IDS`` times ``MOST_PARTS`` ids at most come to the driver,
    however many documents there are, as parts grow from there on),
    sorted there and packed. Repeated ids stand side by side, null ids first;
    extra columns are ignored; an empty table gives an empty file.
    """
    width = max(vocabulary_width(path), int(end_id or 0).bit_length(), 1)
    id_type = docs.schema[doc_id].dataType.simpleString()
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    total = base.count()
    parts = max(1, min(MOST_PARTS, -(-total // PART_DOCS)))
    # the smallest ``PART_IDS`` ids a part by hash, whatever the rows: bounds are their quantiles, shares need not be exact
    some = base.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(min(1.0, PART_IDS * parts / max(1, total)) * (1 << 30))))
    held = sorted(r[0] for r in some.distinct().collect()) if parts > 1 else []
    bounds = sorted({held[i * len(held) // parts] for i in range(1, parts)}) if held else []

    def encode(batch):
        enc = encoder(path)
        ids = [np.frombuffer(enc.encode(t) + tail, "<u4") for t in batch.column(1).to_pylist()]
        part = [0 if k is None else bisect.bisect_right(bounds, k) for k in batch.column(0).to_pylist()]
        return {"part": pa.array(part, pa.int32()), "doc_id": batch.column(0), "n": pa.array([len(x) for x in ids], pa.int64()), "packed": pa.array([pack(x, width) for x in ids], pa.binary())}

    encoded = arrow_map(base, encode, f"part int, doc_id {id_type}, n bigint, packed binary", most_bytes=2 << 20)
    dealt = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first())
    wanted = arrow_schema(f"part int, number int, width int, n_ids bigint, payload binary, doc_ids array<{id_type}>, ends array<bigint>")

    def blocks(batches):
        part, number, keys, ends, held, n = None, 0, [], [], [], 0

        def row():
            return pa.RecordBatch.from_pylist([{"part": part, "number": number, "width": width, "n_ids": n, "payload": pack(np.concatenate(held), width), "doc_ids": keys, "ends": ends}], schema=wanted)

        for batch in rows_of(batches):
            for p, key, size, body in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if keys and (p != part or n >= block_ids):
                    yield row()
                    part, number, keys, ends, held, n = p, number + 1 if p == part else 0, [], [], [], 0
                part = p
                keys.append(key)
                held.append(unpack(body, width, 0, size))
                n += size
                ends.append(n)
        if keys:
            yield row()

    return stage(dealt.mapInArrow(blocks, f"part int, number int, width int, n_ids bigint, payload binary, doc_ids array<{id_type}>, ends array<bigint>"), "packed"), width


def read_packed(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): every document from its block; ``start`` counts the ids of all documents before it.

    Only the blocks' counts are summed across partitions; payloads are
    unpacked where they are read.
    """
    # one row a part of the file: a number for each ``PART_DOCS`` documents
    before = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_part_start"))
    inner = blocks.select("part", "number", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    starts = stage(inner.join(before, "part").select("part", "number", (F.col("_start") + F.col("_part_start")).alias("block_start")), "starts")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint"
    wanted = arrow_schema(schema)

    def read(batches):
        for batch in rows_of(batches, 1):
            start, width, payload, keys, ends = (batch.column(i)[0].as_py() for i in range(5))
            ids, cut = unpack(payload, width, 0, ends[-1]), [0, *ends]
            yield pa.RecordBatch.from_pydict({
                "doc_id": keys, "start": [start + c for c in cut[:-1]], "n_tokens": np.diff(cut),
                "ids_crc32": [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cut, cut[1:])],
            }, schema=wanted)

    return blocks.join(starts, ["part", "number"]).select("block_start", "width", "payload", "doc_ids", "ends").mapInArrow(read, schema)


def documents_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, ids): the token ids themselves, unpacked."""
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, ids array<int>"
    wanted = arrow_schema(schema)

    def read(batches):
        for batch in rows_of(batches, 1):
            width, payload, keys, ends = (batch.column(i)[0].as_py() for i in range(4))
            cut = [0, *ends]
            yield pa.RecordBatch.from_pydict({"doc_id": keys, "ids": [unpack(payload, width, a, b).astype(np.int32) for a, b in zip(cut, cut[1:])]}, schema=wanted)

    return blocks.select("width", "payload", "doc_ids", "ends").mapInArrow(read, schema)


def op9_token_ids(docs: DataFrame, path: str) -> DataFrame:
    """The contract's columns, from the files read back."""
    return read_packed(write_packed(docs, path)[0])
