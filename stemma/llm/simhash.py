"""SimHash near-duplicate groups by multi-index hashing.

A document's fingerprint takes each bit from the majority of its shingles' 64-bit hashes.
Fingerprints within `radius` 3 link. Two 32-bit segments index the distinct fingerprints: of
two that differ in at most 3 bits, one segment differs in at most one, so each fingerprint
enumerates the radius-1 Hamming ball of each segment (clearing one set bit; the fingerprint
that has the bit set finds the other) and looks the values up in that segment's table.
Members of a bucket are verified at full distance, each reached member once, giving a
spanning forest and never all pairs. A bucket of over BUCKET rows is dealt anew by the
centres of small balls in the other segment: x and y within 3 meet at a centre within 1 of
one and the rest of the other; such sub-buckets have at most some thousand rows.

A fingerprint held by a large share of the documents gets its component by broadcast.

Defined results: null, empty and blank texts have fingerprint zero, linked like any other; very
long texts are hashed whole; equal distances need no order, since all within reach link;
repeated rows share a group; null doc_ids get a row and are no component's least; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.operators.components import components
from stemma.operators.joins import hot_join
from stemma.storage import lean, stored

BUCKET = 20_000


def digests(text: bytes, shingle: int = 3, seed: int = 42) -> bytes:
    """XXH64 of every shingle in order, repeats included; nothing for a text without words."""
    from xxhash import xxh64_digest

    words = text.lower().split()  # bytes: only A-Z change; splits at 0x20 and 0x09-0x0D
    if not words:
        return b""
    joined = b" ".join(words)
    lengths = np.array([len(w) + 1 for w in words])
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: max(1, len(words) - shingle + 1)].tolist()
    stops = (ends - 1)[min(shingle, len(words)) - 1 :].tolist()
    return b"".join([xxh64_digest(joined[a:z], seed) for a, z in zip(starts, stops)])


def majority(hashes: bytes) -> int:
    """The fingerprint of digests(): a bit is 1 if set in over half of them."""
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64)
    n, whole = len(bits), len(bits) // 255 * 255
    count = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        count += bits[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    return majority(digests(text, shingle, seed))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), "doc_id bigint, fp bigint")


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that link what is within radius, a tree for each part."""
    out, left = [], np.unique(fps)
    while len(left):
        root, stack, left = int(left[0]), [left[0]], left[1:]
        while stack and len(left):
            near = np.bitwise_count((left ^ stack.pop()).view(np.uint64)) <= radius
            if near.any():
                got = left[near]
                out += [(root, int(x)) for x in got]
                stack += list(got)
                left = left[~near]
    return out


def links(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links. fps: stored, one row each."""
    if radius > 3:
        raise ValueError("two segments with balls of radius 1 find distances up to 3")
    segment = F.explode(F.expr("array(struct(0 as seg, shiftrightunsigned(fp, 32) as v), struct(1 as seg, fp & 4294967295L as v))"))
    table = fps.select("fp", segment.alias("s")).select("fp", "s.seg", "s.v")
    flips = F.explode(F.expr("transform(filter(sequence(0, 31), k -> (shiftrightunsigned(v, k) & 1L) = 1), k -> v ^ shiftleft(1L, k))"))
    probes = table.select("fp", "seg", flips.alias("v"))
    known = table.select(F.col("seg").alias("_s"), F.col("v").alias("_v")).distinct()
    hits = probes.join(known, (F.col("seg") == F.col("_s")) & (F.col("v") == F.col("_v")), "left_semi")
    rows = table.withColumn("d", F.lit(0)).unionByName(hits.withColumn("d", F.lit(1)))
    sizes = rows.groupBy(F.col("seg").alias("_s"), F.col("v").alias("_v")).count().filter("count > 1")
    rows = stored(rows.join(sizes, (F.col("seg") == F.col("_s")) & (F.col("v") == F.col("_v"))).select("seg", "v", "fp", "d", "count"), "buckets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done(groups: list[np.ndarray]) -> pa.RecordBatch:
            e = np.array([x for g in groups for x in _forest(g, radius)], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for b in batches:
            seg, v, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if not len(fp):
                continue
            cut = np.flatnonzero((seg[1:] != seg[:-1]) | (v[1:] != v[:-1])) + 1
            groups = np.split(fp, cut)
            if key == (seg[0], v[0]):
                groups[0] = np.concatenate([*held, groups[0]])
            elif held:
                yield done([np.concatenate(held)])
            key, held = (seg[-1], v[-1]), [groups.pop()]
            if groups:
                yield done(groups)
        if held:
            yield done([np.concatenate(held)])

    small = rows.filter(F.col("count") <= bucket).select("seg", "v", "fp").repartition("seg", "v").sortWithinPartitions("seg", "v").mapInArrow(lean(verify), "a bigint, b bigint")
    large = rows.filter(F.col("count") > bucket)
    if large.isEmpty():
        return small.distinct()
    other = "if(seg = 0, fp & 4294967295L, shiftrightunsigned(fp, 32))"
    ones = f"transform(sequence(0, 31), k -> {other} ^ shiftleft(1L, k))"
    twos = f"flatten(transform(sequence(1, 31), k -> transform(sequence(0, k - 1), j -> {other} ^ shiftleft(1L, k) ^ shiftleft(1L, j))))"
    centres = F.expr(f"if(d = 0, concat(array({other}), {ones}, {twos}), concat(array({other}), {ones}))")
    spread = large.repartition("fp", "v").select("seg", "v", "fp", "d", F.explode(centres).alias("z"))
    near = (F.col("d") == 0) & (F.bit_count(F.expr(f"{other} ^ z")) <= 1)
    w = Window.partitionBy("seg", "v", "z")
    stars = spread.withColumn("rep", F.min(F.when(near, F.col("fp"))).over(w)).filter("rep <> fp").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
    stars = stars.filter(F.bit_count(F.expr("a ^ b")) <= radius)
    return small.unionByName(stars).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint, component_id (the smallest doc_id linked, directly or not)."""
    rows = stored(fingerprints(docs, id_col), "fingerprints")
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    parts = stored(components(stored(links(firsts.select("fp"), radius, bucket), "links")), "parts")
    firsts = firsts.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = firsts.groupBy("component").agg(F.min("first").alias("component_id"))
    of = firsts.join(least, "component").select("fp", "component_id")
    return hot_join(rows, of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def firsts(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The document with the smallest doc_id of each group. Rows that repeat a doc_id are one document; rows without one stay."""
    chosen = grouped.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_kept")).count()
    chosen = stored(chosen, "chosen")
    once, more = chosen.filter("count = 1"), chosen.filter("count > 1")
    kept = docs.join(once, F.col("doc_id") == F.col("_kept"), "left_semi").unionByName(docs.filter("doc_id is null"))
    if not more.isEmpty():
        kept = kept.unionByName(docs.join(more, F.col("doc_id") == F.col("_kept"), "left_semi").dropDuplicates(["doc_id"]))
    return kept
