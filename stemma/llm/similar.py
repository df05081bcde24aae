"""Near copies for the pipeline: SimHash links verified by exact Jaccard similarity, and completed.

Fingerprints within 3 bits hold few of the pairs at Jaccard 0.8 of 5-word shingles (about 10 of
64 bits differ there), so the Hamming balls of `simhash` give the first links, each verified on
the whole shingle sets, and prefix filtering finds all that they cannot reach. Under one order of
all hashes, two sets with similarity of at least t share a hash among the first
n - ceil(t * n) + 1 of each (n: the set's size), so documents are indexed by these only. Any
order is right; hashes frequent in one document of SAMPLED (at most HOT of them) go last, so
that few documents meet at a passage that many hold.

Only the components of the links are wanted. A key's members of one size class are first held
against one of them in each of STARS rounds: at first the one with the fewest rarer hashes before
the key (of edited copies the least edited, to which most others are similar), then any (of keys with at most FEW members only one in THINNED
is taken up here), the first together with the pairs by fingerprint; pairs linked by then,
directly or not, are settled, and so is a key whose members are all in one component. What is
linked goes into the next round as one edge from each set to its component. Then all pairs that share a key and are not settled have their
turn; at a key of many members only those sets meet whose rest from that key on can be similar,
as two sets' first common key lets all similar pairs through, and of these only those whose
parities differ in no more bits than similar sets may in hashes. Common hashes are either in both prefixes or beyond one of them, so what two prefixes share
bounds the overlap, and whole sets are made, from the texts, only for pairs that can reach the
threshold. Equal sets are one; texts and sets are known by 64-bit hashes.

Defined results: words are split at ASCII white space, A-Z lower-cased; a text of fewer words
than a shingle is one shingle; very long texts are whole sets; null, empty and blank texts are
copies of each other; ties between copies go to the smallest doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.llm.simhash import digests, firsts, links, majority
from stemma.operators.components import components
from stemma.operators.joins import among, hot_join
from stemma.storage import discard, lean, stored

SHINGLE = 5
PERCENT = 80
SAMPLED = 16
HOT = 200_000
FEW = 16
STARS = 2
THINNED = 8
BITS = 512
BATCH_BYTES = 4 << 20


def shingles(hashes: bytes) -> np.ndarray:
    """Distinct hashes in ascending order."""
    return np.unique(np.frombuffer(hashes, "<i8"))


def _sid(data: bytes) -> int:
    return int.from_bytes(hashlib.md5(data).digest()[:8], "little", signed=True)


def _parity(hashes: np.ndarray) -> np.ndarray:
    """BITS bits, each the parity of the hashes that fall on it: two sets differ in at least as many hashes as these in bits."""
    return np.packbits((np.bincount(hashes & (BITS - 1), minlength=BITS) & 1).astype(np.uint8)).view("<i8")


def _bytes(t: pa.Scalar) -> bytes:
    return t.as_buffer().to_pybytes() if t.is_valid else b""


def _hot(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent hashes, ascending, and their places from the rarest on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    yield pa.RecordBatch.from_arrays([pa.array(shingles(digests(_bytes(t), size)))], ["k"])

    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0).select("text").mapInArrow(lean(run), "k bigint")
    top = some.groupBy("k").count().filter("count > 1").orderBy(F.desc("count"), "k").limit(HOT).toArrow()
    keys = top.column("k").to_numpy()[::-1]
    order = np.argsort(keys)
    return keys[order], order + 1


def _rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, mark (a hash of the text), sid (equal for equal sets), n, fp, prefix, bits (_parity)."""
    sent = docs.sparkSession.sparkContext.broadcast(_hot(docs, size))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ["doc_id", "mark", "sid", "n", "fp", "prefix", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, place = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                c, rows = b.slice(at, 1000), []
                for d, m, t in zip(*c.columns):
                    raw = digests(_bytes(t), size)
                    h = shingles(raw)
                    n, rank = len(h), np.zeros(len(h), np.int64)
                    if len(hot):
                        k = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                        rank = np.where(hot[k] == h, place[k], 0)
                    take = n - -(-percent * n // 100) + 1 if n else 0
                    fp = majority(raw)
                    rows.append((d.as_py(), m.as_py(), _sid(h.tobytes()), n, fp - (fp >> 63 << 64), h[np.argsort(rank, kind="stable")[:take]], _parity(h)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    return _marked(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "mark", "text").mapInArrow(lean(run), "doc_id bigint, mark bigint, sid bigint, n int, fp bigint, prefix array<bigint>, bits array<bigint>")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """sid, hashes of the wanted (mark, sid), made anew from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                sets = [shingles(digests(_bytes(t), size)).tobytes() for t in b.column(0)[at : at + 200]]
                yield pa.RecordBatch.from_arrays([pa.array(map(_sid, sets), pa.int64()), pa.array(sets, pa.binary())], ["sid", "hashes"])

    texts = among(_marked(docs).select("mark", "text"), wanted, "mark").dropDuplicates(["mark"])
    return texts.select("text").mapInArrow(lean(run), "sid bigint, hashes binary")


def _possible(pairs: DataFrame, once: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of sids whose prefixes share enough."""
    some = among(once.select("sid", "n", "prefix"), pairs.select(F.explode(F.array("a", "b")).alias("sid")), "sid")
    for k in "ab":
        pairs = pairs.join(some.select(*(F.col(c).alias(f"{c}_{k}") for c in some.columns)), F.col(k) == F.col(f"sid_{k}"))
    most = F.size(F.array_intersect("prefix_a", "prefix_b")) + F.greatest(*(F.col(f"n_{k}") - F.size(f"prefix_{k}") for k in "ab"))
    return pairs.withColumn("_most", most).filter(f"100 * _most >= {percent} * (n_a + n_b - _most)").select("a", "b")


def _verified(pairs: DataFrame, once: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sids whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), "<i8") for v in (x, y))
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(y) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(pairs, "pairs")
    sids = stored(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "pair_sids")
    sets = stored(_sets(docs, among(once.select("mark", "sid"), sids, "sid"), size), "pair_sets")
    x, y = (sets.select(F.col("sid").alias(k), F.col("hashes").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    found = stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(run), "a bigint, b bigint"), "near")
    for old in (pairs, sids, sets):
        discard(old)
    return found


def _by_fingerprint(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sids with equal fingerprints or such as simhash links: each held against its fingerprint's first."""
    of = stored(rows.groupBy("sid").agg(F.first("fp").alias("fp")), "fp_of")
    heads = stored(of.groupBy("fp").agg(F.min("sid").alias("head")), "fp_heads")
    same = hot_join(of, heads, "fp").filter("sid <> head").select(F.col("head").alias("x"), F.col("sid").alias("y"))
    a, b = (heads.select(F.col("fp").alias(k), F.col("head").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    near = links(heads.select("fp")).join(a, "a").join(b, "b").select("x", "y")
    return same.unionByName(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, component_id (the smallest doc_id linked, directly or not). percent: the least similarity."""
    rows = stored(_rows(docs, shingle, percent), "near_rows")
    once = stored(rows.select("mark", "sid", "n", "fp", "prefix", "bits").dropDuplicates(["sid"]), "near_once")
    key = Window.partitionBy("k")
    # c: the key's members; rest: hashes beyond the prefix; at: the key's place in the order of the set
    met = once.select("sid", "n", (F.col("n") - F.size("prefix")).alias("rest"), F.posexplode("prefix").alias("at", "k"))
    met = stored(met.withColumn("c", F.count("*").over(key)).filter("c > 1"), "met")

    fits = f"sid <> sid2 and 100 * least(n, n2) >= {percent} * greatest(n, n2)"
    other = lambda x: x.select("k", *(F.col(c).alias(f"{c}2") for c in x.columns if c not in ("k", "c")))
    differ = " + ".join(f"bit_count(bits[{i}] ^ bits2[{i}])" for i in range(BITS // 64))
    close = f"{100 + percent} * ({differ}) <= {100 - percent} * (n + n2)"  # sets of n and n2 hashes that differ in more than this allows are not similar
    size = F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")  # sets of one size class can be similar
    ends = (F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b"))

    parts = None
    for turn in range(STARS + 1):
        left = met.filter((F.col("c") > FEW) | (F.pmod(F.xxhash64("k", F.lit(turn)), F.lit(THINNED)) == 0)) if turn < STARS else met
        if parts is None:
            left = left.withColumn("part", F.col("sid"))
        else:
            left = left.join(parts, "sid", "left").withColumn("part", F.coalesce("component", "sid")).drop("component")
            left = left.withColumn("_one", F.min("part").over(key) == F.max("part").over(key)).filter("not _one").drop("_one")
        if turn < STARS:
            place = F.col("at") if turn == 0 else F.lit(0)  # the fewest rarer hashes before the key: of edited copies, the one least edited
            centre = F.min(F.struct(place, F.xxhash64("sid", F.lit(turn)), F.struct("sid", "n", "part").alias("s"))).over(Window.partitionBy("k", "size"))["s"]
            pairs = left.withColumn("size", size).withColumn("r", centre).select("sid", "n", "part", F.col("r.sid").alias("sid2"), F.col("r.n").alias("n2"), F.col("r.part").alias("part2"))
            pairs = pairs.filter(f"part <> part2 and {fits}").select(*ends)
            pairs = pairs.unionByName(_by_fingerprint(once)) if parts is None else pairs
            pairs = _possible(stored(pairs.distinct(), "star_pairs"), once, percent)
        else:
            left = stored(left, "left")
            large, small = left.filter(F.col("c") > FEW).join(once.select("sid", "bits"), "sid"), left.filter(F.col("c") <= FEW)
            many = met.filter(F.col("c") > FEW).groupBy("sid").agg(F.count("*").alias("many"))
            small = small.join(other(small), "k").filter(f"sid < sid2 and part <> part2 and {fits}").groupBy("sid", "sid2", "n", "n2", "rest", "rest2").count()
            small = small.join(many, "sid", "left").join(many.select(F.col("sid").alias("sid2"), F.col("many").alias("many2")), "sid2", "left")
            most = "count + least(coalesce(many, 0), coalesce(many2, 0)) + greatest(rest, rest2)"
            small = small.filter(f"100 * ({most}) >= {percent} * (n + n2 - ({most}))").select(*ends)
            first = "least(n - at, n2 - at2)"  # the overlap at most, where the key is the first that two sets share: each similar pair meets at that one
            large = stored(large.join(other(large), "k").filter(f"sid < sid2 and part <> part2 and {fits} and 100 * {first} >= {percent} * (n + n2 - {first}) and {close}").select(*ends).distinct(), "large_pairs")
            pairs = small.unionByName(_possible(large, once, percent)).distinct()
        near = _verified(pairs, once, docs, shingle, percent)
        edges = near if parts is None else near.unionByName(parts.select(F.col("sid").alias("a"), F.col("component").alias("b")))
        parts = stored(components(edges).withColumnRenamed("node", "sid"), "near_parts")
    own = stored(rows.groupBy("sid").agg(F.min("doc_id").alias("first")), "set_firsts")
    of = own.join(parts, "sid", "left").withColumn("part", F.coalesce("component", "sid"))
    of = of.join(of.groupBy("part").agg(F.min("first").alias("component_id")), "part").select("sid", "component_id")
    return hot_join(rows.select("doc_id", "sid"), of, "sid").select("doc_id", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest doc_id of each group."""
    return firsts(docs, groups(docs, shingle, percent))
