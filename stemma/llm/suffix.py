"""Repeated byte strings, found by column-wise construction of a collection BWT with its common prefixes.

A string of LENGTH bytes that starts in two places is removed in both. Which texts can share
one is settled by content: each window of LENGTH bytes picks an anchor, the 16-byte gram of
least hash in it, so equal windows pick equal anchors at equal offsets. Consecutive windows
with one anchor form a segment, cut in two by the side of the anchor on which each of its
windows is sure to have CONTEXT more bytes; segments are dealt by the hash of anchor and
context. What meets nobody there repeats nowhere.

The segments that meet are a document collection, each distinct one with its count. Its BWT
is built column by column: every round inserts one symbol of each segment, from the right,
refines the order of the suffixes by it and updates the common prefix of neighbours by range
minima. Since segments that can match are aligned at their anchors, a round only has to order
the suffixes inserted in it, within their collection; many collections share a round. Columns
are laid out in the order of the rounds and read once in that order, from a file of the task's
own where they exceed MEMORY bytes, as those of a full batch do; the file has no name, nobody
else reads it, and it goes with the task. After the round of a window's first byte, neighbours with a common prefix of
LENGTH are repeats, and so is a segment with a count over one.

A passage in a large share of all documents puts its segments under one key. Such keys, and
the segments that repeat as often, are known from the occurrences of a share of the documents;
this only places rows and decides no result. Their occurrences repeat, so that they need no
count and lie anywhere; joins on them are salted. If such a collection has over GIANT distinct
segments, it is dealt anew by whole windows, each a collection of one, whose count decides.

Segments are told apart by two independent 64-bit hashes, of anchor and context and of content.

Defined results: null is the empty text; texts below LENGTH bytes keep all; very long texts are
cut into segments like others; repeated rows remove each other wholly; strings are judged on the input; an empty table gives no rows; extra
columns are ignored by removal() and kept by strip().
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.storage import lean, stored

LENGTH = 200
GRAM = 16
BLOCK_BYTES = 1 << 20
BATCH = 20_000
MEMORY = 4 << 20
SHARE = 64  # one document in so many shows which keys are frequent
HOT = 32  # occurrences there that make a key frequent
LISTED = 200_000  # as many frequent keys are broadcast at most; beyond it they need more occurrences
SALTED = 16_384  # occurrences of a frequent segment to a salt
GIANT = 20_000

_A = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _table() -> np.ndarray:
    return _mix(_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_A)))


def _grams(data: np.ndarray) -> dict[int, np.ndarray]:
    """size -> polynomial hashes of all grams of that size, sizes powers of two up to 64."""
    out = {1: _table()[data]}
    for size in (1, 2, 4, 8, 16, 32):
        h = out[size]
        out[2 * size] = h[:-size] * np.uint64(pow(_A, size, 1 << 64)) + h[size:]
    return out


def _context(h: dict[int, np.ndarray], at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the size bytes from each place on."""
    total = np.zeros(len(at), np.uint64)
    for step in (64, 32, 16, 8, 4, 2, 1):
        while size >= step:
            total = total * np.uint64(pow(_A, step, 1 << 64)) + h[step][at]
            at, size = at + step, size - step
    return total


def segments_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """text, key, content hash, first window, last window (both within the text), anchor (likewise), of each segment."""
    from xxhash import xxh3_64_intdigest

    blob = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    none = np.zeros(0, np.int64)
    if len(blob) < length:
        return none, none, none, none, none, none
    data = np.frombuffer(blob, np.uint8)
    h = _grams(data)
    w = length - GRAM + 1
    x = (_mix(h[GRAM]) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h[GRAM]), dtype=np.uint64)
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if w > span:
        x = np.minimum(x[: len(x) - (w - span)], x[w - span :])
    anchor = (x & np.uint64(0xFFFFFFFF)).astype(np.int64)  # by window start
    ends = np.cumsum(sizes)
    inside = np.zeros(len(anchor) + 1, np.int8)  # windows that cross no text's end
    ok = sizes >= length
    np.add.at(inside, (ends - sizes)[ok], 1)
    np.add.at(inside, (ends - length + 1)[ok], -1)
    valid = np.cumsum(inside[:-1]) > 0
    side = (length - GRAM) // 2
    starts = np.arange(len(anchor))
    left = anchor - starts > side  # the context is on the left of the anchor
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (left[1:] != left[:-1]) | (valid[1:] != valid[:-1])]
    edge = (ends - sizes)[(ends - sizes) < len(new)]
    new[edge] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(anchor)] - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    p, lft = anchor[first], left[first]
    key = _context(h, np.where(lft, p - side, p), GRAM + side)
    key = _mix(key + lft.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
    content = np.array([xxh3_64_intdigest(blob[a : z + length]) for a, z in zip(first.tolist(), last.tolist())], np.uint64)
    which = np.searchsorted(ends, first, "right")
    base = (ends - sizes)[which]
    return which, key.view(np.int64), content.view(np.int64), first - base, last - base, p - base


def repeats(group: np.ndarray, count: np.ndarray, shift: np.ndarray, texts: list[bytes], columns: int, length: int = LENGTH) -> np.ndarray:
    """For each segment and column, whether the window from that column on repeats in the segment's group.

    group: ascending; shift: column of a segment's first byte. Returns bool [columns, segments]."""
    m = len(texts)
    sizes = np.array([len(t) for t in texts])
    with tempfile.TemporaryFile() as external:
        shape = (columns, m)
        symbols = np.memmap(external, np.int16, "w+", shape=shape) if 2 * columns * m > MEMORY else np.zeros(shape, np.int16)
        blob = np.frombuffer(b"".join(texts), np.uint8)
        row = np.repeat(np.arange(m), sizes)
        column = np.arange(len(blob)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(shift, sizes)
        symbols[column, row] = blob.astype(np.int16) + 1  # 0: the segment has no symbol here
        order = np.arange(m)
        common = np.zeros(m, np.int16)  # with the one before in order
        base = group.astype(np.int64) << 9
        fence = np.r_[True, group[1:] != group[:-1]]  # order always runs through the groups in turn
        found = np.zeros(shape, bool)
        for c in range(columns - 1, -1, -1):
            s = np.array(symbols[c])[order].astype(np.int64)
            code = base[order] | s
            if (code[1:] >= code[:-1]).all():  # this symbol changes no order
                same = np.r_[False, code[1:] == code[:-1]] & (s > 0)
                common = np.where(same, np.minimum(common + 1, length), 0).astype(np.int16)
            else:
                to = np.argsort(code, kind="stable")
                code, s = code[to], s[to]
                same = np.r_[False, code[1:] == code[:-1]] & (s > 0)
                least = np.zeros(m, np.int16)
                at = np.flatnonzero(same)
                if len(at):
                    a, z = to[at - 1] + 1, to[at] + 1  # the minimum of common[a:z]
                    pairs = np.stack([a, z], 1).ravel()
                    least[at] = np.minimum.reduceat(np.r_[common, np.int16(0)], pairs)[::2]
                common = np.where(same, np.minimum(least + 1, length), 0).astype(np.int16)
                order = order[to]
            equal = (common >= length) & ~fence
            hit = equal | np.r_[equal[1:], False]
            found[c, order] = hit
        first = np.arange(columns)[:, None]
        alone = (count > 1) & (first >= shift) & (first + length <= shift + sizes)
        if isinstance(symbols, np.memmap):
            del symbols
        return found | alone


def _occurrences(docs: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            a, size, texts = 0, 0, []
            for k, t in enumerate(b.column(2)):
                texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES or k == len(b.column(2)) - 1:
                    which, key, content, s, e, p = segments_of(texts, length)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(ids[a:][which]), pa.array(marks[a:][which]), *(pa.array(x.astype(np.int32)) for x in (s, e, p))], ["key", "content", "id", "mark", "s", "e", "p"])
                    a, size, texts = k + 1, 0, []

    return docs.select("id", "mark", "text").mapInArrow(lean(run), "key bigint, content bigint, id bigint, mark bigint, s int, e int, p int")


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with a join key that tells texts apart where ids repeat or are null."""
    return docs.withColumns({"id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))), "mark": F.xxhash64(text_col)})


def _frequent(sampled: DataFrame, by: list[str], hot: int) -> DataFrame:
    """Keys with at least `hot` sampled occurrences, and more where over LISTED have; n: how many."""
    found = stored(sampled.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") >= hot), "frequent")
    while found.filter(F.col("n") >= hot).count() > LISTED:
        hot *= 2
    return found.filter(F.col("n") >= hot)


def spans(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", share: int = SHARE, hot: int = HOT, giant: int = GIANT) -> DataFrame:
    """id, mark, places: array<struct<s, z>> of repeated bytes, half-open; for documents that have any."""
    texts = _identified(docs.select(id_col, text_col), id_col, text_col).select("id", "mark", F.col(text_col).alias("text"))
    side = (length - GRAM) // 2
    columns = side + 1 + length
    sampled = stored(_occurrences(texts.filter(F.pmod(F.xxhash64("id", "mark"), F.lit(share)) == 0), length).select("key", "content"), "sampled")
    keys = F.broadcast(_frequent(sampled, ["key"], max(hot, 2)).select("key", F.lit(True).alias("hot")))
    salts = F.broadcast(_frequent(sampled, ["key", "content"], max(hot, 2)).select("key", "content", F.ceil(F.col("n") * share / SALTED).alias("salts")))
    spread = F.xxhash64("id", "mark", "s")
    placed = _occurrences(texts, length).join(keys, "key", "left").join(salts, ["key", "content"], "left").withColumns({"hot": F.coalesce("hot", F.lit(False)), "salt": F.coalesce(F.pmod(spread, F.col("salts")), F.lit(0)).cast("int")})
    met = F.count("*").over(Window.partitionBy("key", F.when(F.col("hot"), spread)))
    seen = stored(placed.withColumn("n", met).filter("n > 1 or hot").drop("n", "salts"), "met")
    distinct = seen.groupBy("key", "content").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "s", "e", "p")).alias("of"), F.max("hot").alias("hot"))
    kinds = F.count("*").over(Window.partitionBy("key", F.when(F.col("hot"), F.col("content"))))
    distinct = stored(distinct.withColumn("kinds", kinds).select("key", "content", "n", "kinds", "hot", "of.*"), "segments")
    of_hot = stored(distinct.filter("hot").groupBy("key").agg(F.count("*").alias("_kinds")), "kinds")
    distinct = distinct.join(F.broadcast(of_hot), "key", "left").withColumn("kinds", F.coalesce("_kinds", "kinds")).drop("_kinds")
    huge = F.col("hot") & (F.col("kinds") > giant)
    several = distinct.filter("kinds > 1").groupBy("id", "mark").agg(F.collect_list(F.struct("key", "content", "n", "s", "e", "p", huge.alias("huge"))).alias("parts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "content", "n", "shift", "bytes", "huge"]
        for b in batches:
            rows: list[list] = [[] for _ in names]
            size = 0
            for t, parts in zip(b.column(0), b.column(1)):
                data = t.as_buffer().to_pybytes()
                for x in parts.as_py():
                    part = data[x["s"] : x["e"] + length]
                    size += len(part)
                    before = x["p"] - x["s"]  # the anchor's column is `side` or, if the context is on its left, 2 * side
                    for to, v in zip(rows, (x["key"], x["content"], x["n"], (2 * side if before > side else side) - before, part, x["huge"])):
                        to.append(v)
                if size > BLOCK_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(r, ty) for r, ty in zip(rows, types)], names)
                    rows, size = [[] for _ in names], 0
            yield pa.RecordBatch.from_arrays([pa.array(r, ty) for r, ty in zip(rows, types)], names)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_()]
    collection = texts.join(several, ["id", "mark"])
    strings = collection.select("text", "parts").mapInArrow(lean(cut), "key bigint, content bigint, n bigint, shift int, bytes binary, huge boolean")
    anew = not of_hot.filter(F.col("_kinds") > giant).isEmpty()
    strings = stored(strings, "strings") if anew else strings

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows: list[tuple]) -> pa.RecordBatch:
            key, content, n, shift, data = zip(*rows)
            key = np.array(key)
            group = np.cumsum(np.r_[0, key[1:] != key[:-1]])
            hit = repeats(group, np.array(n), np.array(shift), list(data), columns, length)
            masks = []
            for k, (at, d) in enumerate(zip(shift, data)):
                masks.append(np.packbits(hit[at : at + len(d) - length + 1, k]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(content, pa.int64()), pa.array(masks, pa.binary())], ["key", "content", "mask"])

        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            for row in zip(*cols):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield done(held)
                    held = []
                if not held or row[:2] != held[-1][:2]:  # a repeated row's text comes once for each copy
                    held.append(row)
        if held:
            yield done(held)

    masks = strings.filter("not huge").drop("huge").repartition("key").sortWithinPartitions("key", "content").mapInArrow(lean(build), "key bigint, content bigint, mask binary")
    if anew:
        masks = masks.unionByName(_by_window(strings.filter("huge"), length))
    flags = distinct.filter("kinds = 1 and n > 1").select("key", "content", F.lit(None).cast("binary").alias("mask")).unionByName(masks)
    flags = stored(flags.filter("mask is null or hex(mask) rlike '[^0]'"), "flags")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts").cast("int"), F.lit(1)) - 1)).alias("salt")
    flags = flags.join(salts, ["key", "content"], "left").select("key", "content", "mask", copies)
    hits = seen.join(flags, ["key", "content", "salt"]).select("id", "mark", "s", "e", "mask").distinct()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, marks, s, e = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            at, low, high = [], [], []
            for k, m in enumerate(b.column(4)):
                if not m.is_valid:
                    at.append(k), low.append(s[k]), high.append(e[k] + length)
                    continue
                f = np.diff(np.r_[0, np.unpackbits(np.frombuffer(m.as_py(), np.uint8), count=e[k] - s[k] + 1), 0].astype(np.int8))
                for x, y in zip(np.flatnonzero(f == 1).tolist(), np.flatnonzero(f == -1).tolist()):
                    at.append(k), low.append(s[k] + x), high.append(s[k] + y - 1 + length)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(marks[at], pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32())], ["id", "mark", "s", "z"])

    found = hits.mapInArrow(lean(ranges), "id bigint, mark bigint, s int, z int")
    return stored(found.groupBy("id", "mark").agg(F.collect_list(F.struct("s", "z")).alias("places")), "spans")


def _by_window(strings: DataFrame, length: int) -> DataFrame:
    """key, content, mask of segments dealt anew by whole windows. strings: key, content, n, bytes, repeated rows once for each copy."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for b in batches:
            for k, data in enumerate(b.column(3)):
                data = data.as_py()
                h = np.array([xxh3_64_intdigest(data[a : a + length]) for a in range(len(data) - length + 1)], np.uint64).view(np.int64)
                same = lambda c: pa.array(np.full(len(h), b.column(c)[k].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([same(0), same(1), same(2), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h)], ["key", "content", "n", "at", "h"])

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for at in b.column(2):
                at = np.array(at.as_py())
                bits = np.zeros(at.max() + 1, np.uint8)
                bits[at] = 1
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["key", "content", "mask"])

    once = strings.groupBy("key", "content").agg(F.first("n").alias("n"), F.first("bytes").alias("bytes"))
    found = stored(once.mapInArrow(lean(windows), "key bigint, content bigint, n bigint, at int, h bigint"), "windows")
    repeated = found.groupBy("key", "h").agg(F.sum("n").alias("_n")).filter("_n > 1").select("key", "h")
    hit = found.join(repeated, ["key", "h"]).groupBy("key", "content").agg(F.collect_list("at").alias("at"))
    return hit.mapInArrow(lean(masks), "key bigint, content bigint, mask binary")


def _merged(places) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, z in sorted((p["s"], p["z"]) for p in places or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([s, z])
    return [tuple(x) for x in out]


def removal(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    marked = _identified(docs.select(id_col, text_col), id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    places = spans(docs, length, id_col, text_col)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for t, p in zip(b.column(1), b.column(2)):
                data, runs, at, sha = (t.as_buffer().to_pybytes() if t.is_valid else b""), _merged(p.as_py()), 0, hashlib.sha256()
                for s, z in runs:
                    sha.update(data[at:s])
                    at = z
                sha.update(data[at:])
                for to, v in zip(rows, (len(data), sum(z - s for s, z in runs), len(runs), sha.hexdigest())):
                    to.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r, ty) for r, ty in zip(rows, [pa.int64()] * 3 + [pa.string()]))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    joined = marked.join(places, ["id", "mark"], "left").select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), "places")
    return joined.mapInArrow(lean(cut), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with repeats taken out of the text; a character only partly covered stays."""
    marked = docs.withColumns({"_s_id": F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))), "_s_mark": F.xxhash64(text_col)})
    places = spans(docs, length, id_col, text_col).toDF("_s_id", "_s_mark", "_s_places")
    joined = marked.join(places, ["_s_id", "_s_mark"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, p in zip(b.column(text_col), b.column("_s_places")):
                if not p.is_valid or not t.is_valid:
                    out.append(t.as_py())
                    continue
                data, kept, at = t.as_buffer().to_pybytes(), [], 0
                for s, z in _merged(p.as_py()):
                    while s < z and data[s] & 0xC0 == 0x80:  # a character begun before s
                        s += 1
                    while z > s and z < len(data) and data[z] & 0xC0 == 0x80:  # and one that ends after z
                        z -= 1
                    kept.append(data[at:s])
                    at = max(at, z)
                out.append(b"".join([*kept, data[at:]]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == text_col else b.column(n) for n in names], names)

    names = docs.columns
    return joined.select(*names, "_s_places").mapInArrow(lean(cut), docs.schema)
