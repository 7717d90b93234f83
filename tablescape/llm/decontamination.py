"""Benchmark decontamination by a positional inverted index over the training tokens.

The index is partitioned by documents: a row of it covers some megabytes of
text and holds, for each indexed term, the sorted positions at which it
stands. Phrases are found within a row by intersecting the terms' position
lists, adjusted by their offsets in the phrase, from the rarest term on; a
benchmark's windows all at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescape.llm.common import arrow_schema, identified, rows_of, unused
from tablescape.session import stage

#: Fixed by the contract: a word is a run of ASCII letters and digits and of anything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words in a window.
WINDOW = 13
#: Words of phrases that one pass over the index looks for; a larger benchmark takes several passes.
PASS_WORDS = 500_000
#: Bytes of text in a row of the index.
ROW_BYTES = 8 << 20
#: Positions left free between documents, so that no phrase spans two.
GAP = 64
#: Windows, and positions of their rarest terms, that are tried at once.
BULK_WINDOWS, BULK_PLACES = 1 << 16, 1 << 21


def index_words(text: str | None) -> list[bytes]:
    """Words of the text, A-Z lower-cased."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """Every run of ``size`` consecutive words; the whole of a shorter item; none of an empty one."""
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def build_index(docs: DataFrame, terms: set[bytes] | None = None, text: str = "text", doc_id: str = "doc_id", gap: int = GAP) -> DataFrame:
    """The index as a written table: (row, doc_ids, n_words, starts, terms, ends, positions), a row for some megabytes of text.

    ``terms`` restricts the postings to terms that will be asked for (a set of
    bounded size, shipped to the tasks); None indexes every term. ``ends``
    are the ends of the terms' position lists in ``positions`` (int32 each,
    sorted). Null text has no words; null ids and repeated rows are kept.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"row string, doc_ids array<{id_type}>, n_words array<bigint>, starts binary, terms array<binary>, ends binary, positions binary"
    known = None if terms is None else {t: i for i, t in enumerate(sorted(terms))}
    wanted = arrow_schema(schema)
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def entry(row: int, ids: list, sizes: list[int], codes: list[np.ndarray], names: list[bytes]) -> dict:
        starts = np.cumsum([0, *[n + gap for n in sizes[:-1]]]).astype(np.int64) if sizes else np.empty(0, np.int64)
        at = np.concatenate([np.flatnonzero(c >= 0) + s for c, s in zip(codes, starts)] or [np.empty(0, np.int64)])
        code = np.concatenate([c[c >= 0] for c in codes] or [np.empty(0, np.int32)])
        order = np.argsort(code, kind="stable")
        used, counts = np.unique(code, return_counts=True)
        return {
            "row": f"{TaskContext.get().partitionId()}-{row}", "doc_ids": ids, "n_words": sizes, "starts": starts.astype("<i8").tobytes(), "terms": [names[i] for i in used],
            "ends": np.cumsum(counts).astype("<i8").tobytes(), "positions": at[order].astype("<i4").tobytes(),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value if shared is not None else {}
        names = sorted(lookup) if shared is not None else []
        ids, sizes, codes, held, row = [], [], [], 0, 0
        for batch in rows_of(batches, ROW_BYTES // 4):
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = index_words(body)
                if shared is not None:
                    code = np.fromiter((lookup.get(w, -1) for w in words), np.int32, len(words))
                else:
                    for w in words:
                        if w not in lookup:
                            lookup[w] = len(names)
                            names.append(w)
                    code = np.fromiter(map(lookup.__getitem__, words), np.int32, len(words))
                ids.append(key)
                sizes.append(len(words))
                codes.append(code)
                held += len(body or "")
            if held >= ROW_BYTES:
                yield pa.RecordBatch.from_pylist([entry(row, ids, sizes, codes, names)], schema=wanted)
                ids, sizes, codes, held, row = [], [], [], 0, row + 1
                if shared is None:
                    lookup, names = {}, []
        if ids:
            yield pa.RecordBatch.from_pylist([entry(row, ids, sizes, codes, names)], schema=wanted)

    return stage(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema), "index")


class Postings:
    """One row of the index, ready to be searched."""

    def __init__(self, terms: list[bytes], ends: bytes, positions: bytes):
        self._at, cut = np.frombuffer(positions, "<i4"), np.frombuffer(ends, "<i8")
        self._span = {t: (int(a), int(b)) for t, a, b in zip(terms, np.concatenate([[0], cut]), cut)}

    def of(self, term: bytes) -> np.ndarray:
        a, b = self._span.get(term, (0, 0))
        return self._at[a:b]

    def phrase(self, words: tuple[bytes, ...]) -> np.ndarray:
        """Positions at which ``words`` stand in a row, from the rarest term's list on."""
        lists = sorted(((self.of(w), i) for i, w in enumerate(words)), key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for have, i in lists[1:]:
            if not len(found):
                break
            want = found + i
            found = found[have[np.minimum(np.searchsorted(have, want), len(have) - 1)] == want]
        return found

    def all_of(self, asked: "Phrases") -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of phrases, positions) of all occurrences of all phrases.

        A phrase is tried at the places of its term with the shortest list
        here, if all its terms are here; what stands at the places of the
        others, from the next shortest list on, decides.
        """
        none = len(asked.code)  # pads short phrases: fits everywhere
        count, start = np.zeros(none + 1, np.int64), np.zeros(none + 1, np.int64)
        code = np.fromiter((asked.code.get(t, -1) for t in self._span), np.int32, len(self._span))
        spans = np.array(list(self._span.values()), np.int64).reshape(-1, 2)
        here = code >= 0
        count[code[here]], start[code[here]] = (spans[:, 1] - spans[:, 0])[here], spans[here, 0]
        count[none] = 1 << 40
        term_at = np.full(int(self._at.max(initial=0)) + asked.codes.shape[1] + 1, -1, np.int32)
        term_at[self._at] = np.repeat(code, spans[:, 1] - spans[:, 0])
        for first in range(0, len(asked.codes), BULK_WINDOWS):
            codes = asked.codes[first : first + BULK_WINDOWS]
            sizes = count[codes]
            codes, sizes, number = (x[sizes.min(1, initial=1 << 40) > 0] for x in (codes, sizes, first + np.arange(len(codes))))
            order = np.argsort(sizes, axis=1, kind="stable")
            rarest = order[:, 0] if len(order) else order.reshape(-1)
            key = codes[np.arange(len(codes)), rarest]
            past = np.cumsum(count[key])
            a = 0
            while a < len(codes):
                b = max(a + 1, int(np.searchsorted(past, (past[a - 1] if a else 0) + BULK_PLACES, "right")))
                n = count[key[a:b]]
                p = np.repeat(np.arange(a, b), n)
                at = self._at[np.repeat(start[key[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())].astype(np.int64) - rarest[p]
                for k in range(1, codes.shape[1] + 1):
                    keep = at >= 0 if k == 1 else (term_at[at + which] == want) | (want == none)
                    p, at = p[keep], at[keep]
                    if not len(p) or k == codes.shape[1]:
                        break
                    which = order[p, k]
                    want = codes[p, which]
                if len(p):
                    yield number[p], at
                a = b

    def near(self, words: tuple[bytes, ...], slop: int) -> np.ndarray:
        """Positions of the rarest term around which every word stands within ``slop`` words of its place in the phrase."""
        lists = sorted(((self.of(w), i) for i, w in enumerate(words)), key=lambda x: len(x[0]))
        found = lists[0][0] - lists[0][1]
        for have, i in lists[1:]:
            if not len(found) or not len(have):
                return found[:0]
            want = found + i
            after = np.searchsorted(have, want)
            gap = np.minimum(np.abs(have[np.minimum(after, len(have) - 1)] - want), np.abs(have[np.maximum(after - 1, 0)] - want))
            found = found[gap <= slop]
        return found


class Phrases:
    """Phrases to look for in bulk: their terms as numbers, a row a phrase, and the ids of the items that have them."""

    def __init__(self, found: dict[tuple[bytes, ...], list], window: int):
        self.code = {t: i for i, t in enumerate(sorted({w for x in found for w in x}))}
        self.codes = np.full((len(found), window), len(self.code), np.int32)
        for i, words in enumerate(found):
            self.codes[i, : len(words)] = [self.code[w] for w in words]
        self.length = np.array([len(x) for x in found], np.int64)
        self.items = [sorted({str(i) for i in ids if i is not None}) for ids in found.values()]


def _passes(items: DataFrame, text: str, item_id: str, window: int) -> Iterator[dict[tuple[bytes, ...], list]]:
    """Windows with the ids of their items, about ``PASS_WORDS`` words of items at a time; a longer item is divided."""
    found: dict[tuple[bytes, ...], list] = {}
    held = 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = index_words(row["t"])
        for at in range(0, len(words), PASS_WORDS):
            part = words[at : at + PASS_WORDS + window - 1]  # windows that begin in these words
            for w in windows(part, window) if at == 0 or len(part) >= window else []:
                found.setdefault(w, []).append(row["i"])
            held += len(part)
            if held >= PASS_WORDS:
                yield found
                found, held = {}, 0
    yield found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(doc_id, n_words, hits, items): every document with the word positions that windows of benchmark items cover, and these items' ids.

    ``hits`` are [from, past) spans of words, merged; ``items`` the distinct
    ids, as strings, sorted. A window is ``window`` consecutive words of an
    item, or the whole of a shorter one. Null and empty texts have no words;
    items without an id give hits, but no name; repeated items count once and
    repeated documents each. Extra columns are ignored. Empty tables: no
    document, or no hit. Each pass ships about ``PASS_WORDS`` words of items
    to the tasks and is written before the next; documents are never gathered
    or shuffled.
    """
    spark = docs.sparkSession
    passes = _passes(items, item_text, item_id, window)
    found = next(passes)
    more = next(passes, None)
    index = build_index(docs, {w for x in found for w in x} if more is None else None, text, doc_id, gap=window + 1)
    if more is None:
        return _by_document(_search(index, spark.sparkContext.broadcast(Phrases(found, window)), index.columns[:4]))
    done = []
    while found is not None:
        shared = spark.sparkContext.broadcast(Phrases(found, window))
        done.append(stage(_search(index, shared, ["row"]), "hits"))
        shared.destroy()
        found, more = more, next(passes, None)
    hits = done[0]
    for d in done[1:]:
        hits = hits.unionByName(d)
    hits = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"))
    return _by_document(index.select("row", "doc_ids", "n_words", "starts").join(hits, "row"))


def _search(index: DataFrame, phrases, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``index`` rows with the spans and matches (document of the row, item) of ``phrases`` (broadcast)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema.fields if f.name in keep)
    schema = f"{fields}, spans array<binary>, matches array<struct<doc: int, item: string>>"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1):
            row, asked = batch.to_pylist()[0], phrases.value
            starts = np.frombuffer(row["starts"], "<i8")
            spans, matches = [np.empty((0, 2), np.int64)], set()
            for number, at in Postings(row["terms"], row["ends"], row["positions"]).all_of(asked):
                spans.append(merged(np.stack([at, at + asked.length[number]], 1)))
                doc = np.searchsorted(starts, at, "right") - 1
                for d, p in np.unique(np.stack([doc, number], 1), axis=0).tolist():
                    matches.update((d, i) for i in asked.items[p])
            out = {k: row[k] for k in keep}
            out["spans"] = [merged(np.concatenate(spans)).astype("<i8").tobytes()]
            out["matches"] = [{"doc": d, "item": i} for d, i in sorted(matches)]
            yield pa.RecordBatch.from_pylist([out], schema=wanted)

    return index.mapInArrow(run, schema)


def merged(spans: np.ndarray) -> np.ndarray:
    """[from, past) spans, those that meet or overlap made one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], reach[np.concatenate([first[1:] - 1, [len(spans) - 1]])]], 1)


def _by_document(index: DataFrame) -> DataFrame:
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, n_words bigint, hits array<struct<`from`: bigint, past: bigint>>, items array<string>"
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1):
            row = batch.to_pylist()[0]
            starts, spans = np.frombuffer(row["starts"], "<i8"), merged(np.frombuffer(b"".join(row["spans"]), "<i8").reshape(-1, 2))
            out = [{"doc_id": i, "n_words": n, "hits": [], "items": []} for i, n in zip(row["doc_ids"], row["n_words"])]
            for (a, b), d in zip(spans.tolist(), (np.searchsorted(starts, spans[:, 0], "right") - 1).tolist()):
                out[d]["hits"].append({"from": a - int(starts[d]), "past": b - int(starts[d])})
            for m in row["matches"]:
                out[m["doc"]]["items"].append(m["item"])
            for x in out:
                x["items"].sort()
            for at in range(0, len(out), 10_000):
                yield pa.RecordBatch.from_pylist(out[at : at + 10_000], schema=wanted)

    return index.select("doc_ids", "n_words", "starts", "spans", "matches").mapInArrow(run, schema)


def search(index: DataFrame, phrases: dict[str, str], slop: int = 0) -> DataFrame:
    """(doc_id, phrase, at, kind): where the named phrases stand in the indexed documents.

    kind ``phrase``: word for word from word ``at`` on. kind ``proximity``
    (``slop`` above 0): every word within ``slop`` words of its place, seen
    from the phrase's rarest word there; exact matches are not listed again.
    Phrases without words match nothing; repeated documents match each; an
    empty index gives an empty result.
    """
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {id_type}, phrase string, at bigint, kind string"
    asked = {name: tuple(index_words(body)) for name, body in phrases.items()}
    wanted = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 1):
            row = batch.to_pylist()[0]
            postings, starts, out = Postings(row["terms"], row["ends"], row["positions"]), np.frombuffer(row["starts"], "<i8"), []
            for name, words in asked.items():
                if words:
                    exact = postings.phrase(words)
                    near = np.setdiff1d(postings.near(words, slop), exact) if slop else exact[:0]
                    for kind, at in (("phrase", exact), ("proximity", near)):
                        for p in at.tolist():
                            d = max(0, int(np.searchsorted(starts, p, "right")) - 1)
                            out.append({"doc_id": row["doc_ids"][d], "phrase": name, "at": p - int(starts[d]), "kind": kind})
            yield pa.RecordBatch.from_pylist(out, schema=wanted)

    return index.mapInArrow(run, schema)


#: A document is contaminated if it has a hit and hits are one word in this many at least.
SHARE = 20


def _hit_words() -> F.Column:
    return F.aggregate("hits", F.lit(0).cast("bigint"), lambda a, x: a + x["past"] - x["from"])


def clean_documents(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all columns, whatever their names.

    Null and empty texts are clean; repeated rows share their fate; null ids
    stay; empty tables: no document, or all documents. ``docs`` is read twice;
    its rows are known again by their place in a file (``identified``).
    """
    own, tag = docs.columns, unused(docs, "row_tag")
    rows = identified(docs, tag)
    bad = decontaminate(rows.select(tag, "text"), items, doc_id=tag).where((_hit_words() > 0) & (SHARE * _hit_words() >= F.col("n_words")))
    return rows.join(bad.select(F.col("doc_id").alias(tag)), tag, "left_anti").select(*own)


def op7_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns."""
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", _hit_words().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    )
