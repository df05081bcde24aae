"""Benchmark decontamination over a positional inverted index.

The training side is indexed shard by shard: a shard is a run of whole documents of about
SHARD_BYTES, and one stored row holds its term -> sorted positions lists. Positions of two
documents never come within `gap` of each other, so no match crosses a document. Each test window
is filed under its term rarest among the windows, so a shard only takes up windows filed under a
term that it holds, and of these such whose terms it holds all. Their postings lists, shifted by
the term's offset, are intersected from the shard's rarest on; what is left are exact phrase
starts. Nothing is shuffled: a shard answers for its own documents.

Test windows go to the executors as arrays of term numbers, in pieces of at most PIECE_BYTES of
text each; a larger test set takes more passes over the corpus, which is then written once with
row numbers, by which the passes' hits are merged.

Defined results: null and empty texts have no words and no hits; very long texts are whole in
one shard; repeated documents each get a row; repeated items count by item_id; windows of rows
without an item_id hit words but count as no item; an item without words has no window; an empty
documents table gives no rows; an empty benchmark gives rows without hits; spans that meet are
one. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.storage import lean, stored

SHARD_BYTES = 8 << 20
PIECE_BYTES = 16 << 20

#: Bytes of words: 0-9, A-Z (lower-cased), a-z and everything from 0x80; others end a word.
_WORD = bytes(range(0x30, 0x3A)) + string.ascii_letters.encode() + bytes(range(0x80, 0x100))
_FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and b in _WORD else b if b in _WORD else 0x20 for b in range(256))

INDEX_SCHEMA = "shard string, rows array<bigint>, doc_ids array<bigint>, bases binary, n_words binary, terms array<binary>, starts binary, positions binary"
MATCH_SCHEMA = "row bigint, doc_id bigint, n_words bigint, spans array<int>, items array<bigint>"


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Windows:
    """Distinct test windows by term number."""

    terms: list[bytes]
    codes: np.ndarray  # of the items' words
    first: np.ndarray  # a window's first word
    size: np.ndarray  # and its words
    filed: np.ndarray  # windows by the term they are filed under
    under: np.ndarray  # [terms + 1]: where a term's windows begin there
    items: np.ndarray  # item ids by window
    held: np.ndarray  # [windows + 1]: where a window's items begin there


def windows_of(items: list[tuple[int | None, str | None]], size: int) -> Windows:
    number: dict[bytes, int] = {}
    codes, starts, sizes, of = [], [], [], []
    at = 0
    for item, text in items:
        w = [number.setdefault(x, len(number)) for x in words_of((text or "").encode())]
        if w:
            n = max(1, len(w) - size + 1)
            codes += w
            starts.append(np.arange(at, at + n))
            sizes.append(np.full(n, min(size, len(w))))
            of.append(np.full(n, len(of)))
            at += len(w)
    ids = np.array([0 if i is None else i for i, t in items if words_of((t or "").encode())], np.int64)
    named = np.array([i is not None for i, t in items if words_of((t or "").encode())], bool)
    code = np.array(codes, np.int32)
    start, width, item = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (starts, sizes, of))
    first, same = np.zeros(0, np.int64), np.zeros(len(start), np.int64)
    lengths = []
    for n in np.unique(width):  # equal windows are one
        k = np.flatnonzero(width == n)
        _, one, back = np.unique(np.ascontiguousarray(code[start[k][:, None] + np.arange(n)]).view(np.dtype((np.void, 4 * int(n)))).ravel(), return_index=True, return_inverse=True)
        same[k] = len(first) + back
        first = np.r_[first, start[k][one]]
        lengths.append(np.full(len(one), n))
    length = np.concatenate(lengths).astype(np.int64) if lengths else first
    held = np.unique(np.stack([same, ids[item]], 1)[named[item]], axis=0) if len(item) else np.zeros((0, 2), np.int64)
    # filed under the term that fewest windows hold, counted with repeats
    often = np.zeros(len(number), np.int64)
    for n in np.unique(length):
        np.add.at(often, code[first[length == n][:, None] + np.arange(n)].ravel(), 1)
    key = np.zeros(len(first), np.int64)
    for n in np.unique(length):
        k = np.flatnonzero(length == n)
        c = code[first[k][:, None] + np.arange(n)]
        key[k] = c[np.arange(len(k)), often[c].argmin(1)]
    filed = np.argsort(key, kind="stable")
    edges = lambda x, n: np.searchsorted(x, np.arange(n + 1))
    return Windows(list(number), code, first, length, filed, edges(key[filed], len(number)), held[:, 1], edges(held[:, 0], len(first)))


def build_index(docs: DataFrame, vocabulary=None, gap: int = 10, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per shard; documents are numbered by _row where there is such a column. vocabulary: a broadcast set of the terms to keep (postings of other terms answer no query of it); None keeps all."""

    def shard(docs: list[tuple[int, int, bytes]], name: str) -> pa.RecordBatch:
        ids: dict[bytes, int] = {}
        keep = vocabulary.value if vocabulary is not None else None
        bases, counts, at, which, where = [], [], 0, [], []
        for _, _, text in docs:
            w = words_of(text)
            if keep is None:
                code = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int32, len(w))
            else:
                code = np.fromiter(map(keep.get, w, [-1] * len(w)), np.int32, len(w))
            p = np.flatnonzero(code >= 0)
            which.append(code[p])
            where.append(p + at)
            bases.append(at)
            counts.append(len(w))
            at += len(w) + gap
        code, pos = np.concatenate(which), np.concatenate(where)
        order = np.argsort(code, kind="stable")
        code, pos = code[order], pos[order].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, np.int64)
        names = list(ids) if keep is None else vocabulary_names(keep)
        return pa.RecordBatch.from_pydict({
            "shard": pa.array([name]), "rows": pa.array([[r for _, r, _ in docs]], pa.list_(pa.int64())), "doc_ids": pa.array([[d for d, _, _ in docs]], pa.list_(pa.int64())),
            "bases": [np.array(bases, np.int64).tobytes()], "n_words": [np.array(counts, np.int64).tobytes()],
            "terms": pa.array([[names[c] for c in code[starts].tolist()]], pa.list_(pa.binary())),
            "starts": [np.append(starts, len(code)).astype(np.int64).tobytes()],
            "positions": [pos.astype(np.int32).tobytes() if at < 2**31 else pos.tobytes()],
        })

    cached: dict[int, list[bytes]] = {}

    def vocabulary_names(keep: dict[bytes, int]) -> list[bytes]:
        return cached.setdefault(0, list(keep))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for b in batches:
            for d, r, t in zip(*b.columns):
                text = t.as_buffer().to_pybytes() if t.is_valid else b""
                held.append((d.as_py(), r.as_py(), text))
                size += len(text)
                if size >= shard_bytes:
                    yield shard(held, f"{part}-{n}")
                    held, size, n = [], 0, n + 1
        if held:
            yield shard(held, f"{part}-{n}")

    row = F.col("_row") if "_row" in docs.columns else F.monotonically_increasing_id()
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), row.alias("row"), F.col(text_col).alias("text")).mapInArrow(lean(build), INDEX_SCHEMA)


class _Shard:
    def __init__(self, row: dict):
        self.doc_ids, self.bases, self.counts = row["doc_ids"], np.frombuffer(row["bases"], np.int64), np.frombuffer(row["n_words"], np.int64)
        starts = np.frombuffer(row["starts"], np.int64)
        self.pos = np.frombuffer(row["positions"], np.int32 if len(row["positions"]) == 4 * starts[-1] else np.int64)
        self.of = {t: (int(a), int(b)) for t, a, b in zip(row["terms"], starts[:-1], starts[1:])}

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Start positions of the exact phrase: offset-adjusted lists, intersected from the rarest on."""
        lists = []
        for k, t in enumerate(terms):
            r = self.of.get(t)
            if r is None:
                return self.pos[:0]
            lists.append((r[1] - r[0], k, r))
        lists.sort()
        _, k, (a, b) = lists[0]
        found = self.pos[a:b] - k
        for n, k, (a, b) in lists[1:]:
            if not len(found):
                break
            other = self.pos[a:b]
            at = np.searchsorted(other, found + k)
            at[at == n] = 0
            found = found[other[at] == found + k]
        return found

    def near(self, terms: list[bytes], within: int) -> np.ndarray:
        """Positions of the rarest term that have every other term at most `within` words away, same document."""
        if any(t not in self.of for t in terms):
            return self.pos[:0]
        lists = sorted((self.of[t] for t in set(terms)), key=lambda r: r[1] - r[0])
        found = self.pos[slice(*lists[0])]
        doc = np.searchsorted(self.bases, found, "right") - 1
        low, high = np.maximum(found - within, self.bases[doc]), np.minimum(found + within, self.bases[doc] + self.counts[doc] - 1)
        ok = np.ones(len(found), bool)
        for r in lists[1:]:
            other = self.pos[slice(*r)]
            ok &= np.searchsorted(other, high, "right") > np.searchsorted(other, low, "left")
        return found[ok]


def search(index: DataFrame, windows, near: int | None = None) -> DataFrame:
    """Hits of the broadcast Windows by document: merged half-open word spans, flat, and item ids.

    near: None for exact phrases; else every document position around which all the window's
    terms stand within so many words counts (a span is that one word)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        number = {t: k for k, t in enumerate(w.terms)}
        for b in batches:
            for row in b.to_pylist():
                s = _Shard(row)
                lo, hi, docs, items = [], [], [], []
                present = np.zeros(len(w.terms), bool)
                here = [number[t] for t in row["terms"] if t in number]
                present[here] = True
                for c in here:
                    for k in w.filed[w.under[c] : w.under[c + 1]].tolist():
                        terms = w.codes[w.first[k] : w.first[k] + w.size[k]]
                        if not present[terms].all():
                            continue
                        terms = [w.terms[x] for x in terms.tolist()]
                        p = s.phrase(terms) if near is None else s.near(terms, near)
                        if len(p):
                            lo.append(p)
                            hi.append(p + (len(terms) if near is None else 1))
                            d = np.unique(np.searchsorted(s.bases, p, "right") - 1)
                            for i in w.items[w.held[k] : w.held[k + 1]].tolist():
                                docs.append(d)
                                items.append(np.full(len(d), i, np.int64))
                spans: list[list[int]] = [[] for _ in s.doc_ids]
                got: list[list[int]] = [[] for _ in s.doc_ids]
                if lo:
                    a, z = np.concatenate(lo).astype(np.int64), np.concatenate(hi).astype(np.int64)
                    order = np.argsort(a, kind="stable")
                    a, z = a[order], np.maximum.accumulate(z[order])
                    first = np.r_[True, a[1:] > z[:-1]]
                    a, z = a[first], z[np.r_[np.flatnonzero(first)[1:] - 1, len(z) - 1]]
                    d = np.searchsorted(s.bases, a, "right") - 1
                    for k, x, y in zip(d.tolist(), (a - s.bases[d]).tolist(), (z - s.bases[d]).tolist()):
                        spans[k] += (x, y)
                if docs:
                    both = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)], 1), axis=0)
                    for k, i in both.tolist():
                        got[k].append(i)
                n = len(s.doc_ids)
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array(row["rows"], pa.int64()), "doc_id": pa.array(s.doc_ids, pa.int64()), "n_words": pa.array(s.counts),
                    "spans": pa.array(spans, pa.list_(pa.int32())), "items": pa.array(got, pa.list_(pa.int64())),
                })

    return index.mapInArrow(lean(find), MATCH_SCHEMA)


def _pieces(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The test items in pieces of at most PIECE_BYTES of text (one item at least)."""
    held, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("bigint"), text_col).toLocalIterator():
        if held and size + len(r[1] or "") > PIECE_BYTES:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1] or "")
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, near: int | None = None, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """MATCH_SCHEMA rows, one per document: which words of it stand in test windows, and whose."""
    spark = docs.sparkSession
    found = several = None
    pieces = _pieces(benchmark, item_col, "text")
    piece = next(pieces)
    while piece is not None:
        after = next(pieces, None)
        if after is not None and several is None:  # the passes must number the rows alike
            docs = several = stored(docs.select(F.col(id_col), F.col("text"), F.monotonically_increasing_id().alias("_row")), "numbered")
        windows = windows_of(piece, window)
        vocabulary = spark.sparkContext.broadcast({t: k for k, t in enumerate(windows.terms)})
        index = stored(build_index(docs, vocabulary, max(window, near or 0) + 1, id_col), "postings")
        hits = search(index, spark.sparkContext.broadcast(windows), near)
        found = hits if found is None else found.unionByName(hits)
        piece = after
    if several is not None:
        pairs = F.expr("array_sort(flatten(collect_list(transform(sequence(0, cast(size(spans)/2 as int)), i -> if(2*i < size(spans), struct(spans[2*i] as a, spans[2*i+1] as z), null)))))")
        found = found.groupBy("row", "doc_id", "n_words").agg(pairs.alias("p"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        union = """aggregate(filter(p, x -> x is not null), cast(array() as array<int>), (acc, x) ->
            if(size(acc) > 0 and x.a <= element_at(acc, -1), concat(slice(acc, 1, size(acc) - 1), array(greatest(x.z, element_at(acc, -1)))), concat(acc, array(x.a, x.z))))"""
        found = found.select("row", "doc_id", "n_words", F.expr(union).alias("spans"), "items")
    return found


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.expr("aggregate(sequence(0, size(spans)), 0L, (s, i) -> s + if(i < size(spans), if(i % 2 = 0, -spans[i], spans[i]), 0))")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.expr("transform(items, x -> cast(x as string))")), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """docs without those that hold a test window; rows with one doc_id share a fate, rows without one stay."""
    bad = digest(matches(docs, benchmark, window)).filter("contaminated and doc_id is not null").select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"] == bad["_bad"], "left_anti")
