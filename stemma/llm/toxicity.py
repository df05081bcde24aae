"""Toxicity scores from a factorization machine over hashed terms.

A text's features are its distinct words (even places) and each word's first letters (odd
places; inflected and joined forms share them), hashed into 2^bits places. The model adds, to a
weight for each term, the inner product of two terms' factors for each pair, so that it can
learn what words mean together: an insult beside a mention of a group, or either of two words
but not both.

A term's value is its log-odds between the classes in the fitted sample, smoothed towards none,
if these are at least LEAST. Every other word of at least SUPPORT sampled rows stays, as pairs
may tell where its members do not: its value is twice the root of its share of the rows, from
LOW to 1, so that a long text's many ordinary words do not drown the telling ones. Rarer terms
without telling odds have nothing to learn from and are left out.

It is fitted on at most SAMPLE labelled rows, those of least hash, whatever the corpus: a
documented bound. Whole texts are scored, long ones as short ones; labels, languages, sources
and ids are no inputs. The model (1 MB of places and some 10,000 terms) is sent to the executors.

Defined results: null, empty and blank texts get the model's base score; repeated texts get
equal scores; very long texts are scored whole; of rows that repeat a labelled doc_id one is
fitted; with no labelled row of either class everything scores the share of toxic rows
(0 without labels); null labels are left out; an empty table gives no rows; extra columns are
ignored by judged() and kept by score() and keep_clean().
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.storage import lean, trim

BITS = 18
FACTORS = 4
SAMPLE = 24_000
THRESHOLD = 0.3
CACHE_WORDS = 200_000
PREFIXES = (4, 5, 6)
SMOOTH = 10.0
LEAST = 1.0
SUPPORT = 20
LOW = 0.2
STEPS = 300

_KEEP = string.ascii_letters.encode() + bytes(range(0x80, 0x100))
_FOLD = bytes(ord(chr(b).lower()) if b < 0x80 and b in _KEEP else b if b in _KEEP else 0x20 for b in range(256))


class Terms:
    """Words -> hashed feature numbers, or what `to` has for them where that is not negative; one per task, with a bounded cache."""

    def __init__(self, bits: int = BITS, to: np.ndarray | None = None):
        self.mask, self.to, self.known, self.before = (1 << bits) - 1, to, {}, {}

    def _of(self, word: bytes) -> tuple[int, ...]:
        from xxhash import xxh32_intdigest

        s = word.decode(errors="replace").lower()
        begins = {f"{s[:n]}-" for n in PREFIXES if len(s) > n}
        found = (xxh32_intdigest(s, 7) & self.mask & ~1, *(xxh32_intdigest(x, 7) & self.mask | 1 for x in sorted(begins)))
        return found if self.to is None else tuple(k for k in self.to[list(found)].tolist() if k >= 0)

    def features(self, text: bytes) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known, self.before = {}, self.known
        known, found = self.known, set()
        for w in set(text.translate(_FOLD).split()):
            x = known.get(w)
            if x is None:
                x = self.before.get(w)
                x = known[w] = self._of(w) if x is None else x
            if x:
                found.update(x)
        return np.fromiter(found, np.int64, len(found))


@dataclass
class Machine:
    base: float
    place: np.ndarray  # [2^bits], of a term among the model's own; -1: none
    value: np.ndarray  # [terms], of a present term
    weight: np.ndarray  # [terms]
    factor: np.ndarray  # [terms, factors]

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        """rows: the model's own terms of each text."""
        sizes = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.base)
        full = np.flatnonzero(sizes)
        if len(full):
            at = np.concatenate([rows[k] for k in full])
            out[full] += _forward(self, at, np.cumsum(sizes[full]) - sizes[full])[0]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _forward(m: Machine, at: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of terms that begin at cut: linear and pair parts; sums of factors; each term's factors by its value."""
    v = m.factor[at] * m.value[at, None]
    s = np.add.reduceat(v, cut)
    return np.add.reduceat(m.weight[at] * m.value[at], cut) + 0.5 * (s * s - np.add.reduceat(v * v, cut)).sum(1), s, v


def _counts(rows: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for a in range(0, len(rows), 500):
        out += np.bincount(np.concatenate(rows[a : a + 500]), minlength=size)
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, factors: int = FACTORS, epochs: int = 4, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> Machine:
    """Logistic loss, AdaGrad, small batches; small samples are gone through more often, for STEPS batches at least.

    The list of rows is reduced in place to the terms that the model keeps."""
    size, share = 1 << bits, float(labels.mean()) if len(labels) else 0.0
    rng = np.random.default_rng(seed)
    if not len(labels) or share in (0.0, 1.0):
        return Machine(30.0 if share == 1 else -30.0, np.full(size, -1, np.int32), np.zeros(0), np.zeros(0), np.zeros((0, factors)))
    toxic, other = (_counts([r for r, y in zip(rows, labels) if y == k], size) for k in (1, 0))
    odds = np.log((toxic + SMOOTH * share) / share) - np.log((other + SMOOTH * (1 - share)) / (1 - share))
    seen = toxic + other
    plain = (np.arange(size) % 2 == 0) & (seen >= SUPPORT) & (seen < len(rows))
    value = np.where(np.abs(odds) >= LEAST, odds, np.where(plain, np.clip(2 * np.sqrt(seen / len(rows)), LOW, 1), 0))
    used = np.flatnonzero(value)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used))
    m = Machine(float(np.log(share / (1 - share))), place, value[used], np.zeros(len(used)), rng.normal(0, 0.01, (len(used), factors)))
    for k, r in enumerate(rows):
        mine = place[r]
        rows[k] = mine[mine >= 0]
    g_base, g_w, g_v = 1.0, np.ones(len(used)), np.full((len(used), factors), 0.01)
    for _ in range(max(epochs, -(-STEPS * 128 // len(rows)))):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 128):
            part = order[a : a + 128]
            err = np.full(len(part), 1 / (1 + np.exp(-m.base))) - labels[part]  # of rows without terms
            sizes = np.array([len(rows[k]) for k in part])
            full = np.flatnonzero(sizes)
            if len(full):
                at = np.concatenate([rows[k] for k in part[full]])
                z, s, v = _forward(m, at, np.cumsum(sizes[full]) - sizes[full])
                err[full] = 1 / (1 + np.exp(-np.clip(m.base + z, -30, 30))) - labels[part[full]]
                of = np.repeat(np.arange(len(full)), sizes[full])
                by = np.argsort(at, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(at[by]) > 0])
                terms = at[by][first]
                pull = (err[full][of] * m.value[at])[by]
                d_w = np.add.reduceat(pull, first) + decay * m.weight[terms]
                d_v = np.add.reduceat(pull[:, None] * (s[of] - v)[by], first) + decay * m.factor[terms]
                g_w[terms] += d_w**2
                g_v[terms] += d_v**2
                m.weight[terms] -= rate * d_w / np.sqrt(g_w[terms])
                m.factor[terms] -= rate * d_v / np.sqrt(g_v[terms])
            g_base += err.sum() ** 2
            m.base -= rate * err.sum() / np.sqrt(g_base)
    return m


def held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Machine:
    """Fitted on the labelled rows that are not held out; texts become features on the executors."""
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label")).filter(~held_out(id_col))
    chosen = marks.withColumn("_h", F.xxhash64(id_col)).orderBy("_h", id_col).limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col(id_col))
    texts = texts.groupBy("_id").agg(F.min(F.struct(F.xxhash64("_text"), "_text"))["_text"].alias("_text"), F.first("label").alias("label")).select("_id", "_text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            rows = [terms.features(t.as_buffer().to_pybytes()).astype("<i4").tobytes() if t.is_valid else b"" for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2).cast(pa.int32()), pa.array(rows, pa.binary())], ["id", "label", "terms"])

    ids, marked, rows = [], [], []  # at most `sample`
    for r in texts.mapInArrow(lean(run), "id bigint, label int, terms binary").toLocalIterator():
        ids.append(r["id"])
        marked.append(r["label"])
        rows.append(np.frombuffer(bytes(r["terms"]), "<i4"))
    order = np.argsort(ids).tolist()
    rows[:] = [rows[k] for k in order]
    machine = fit(rows, np.array([marked[k] for k in order], float))
    rows.clear()
    trim()
    return machine


def score(docs: DataFrame, machine: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs' columns and the score, called `name`."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(len(sent.value.place).bit_length() - 1, sent.value.place)
        for b in batches:
            out = []
            for a in range(0, b.num_rows, 500):
                out.append(sent.value.scores([terms.features(t.as_buffer().to_pybytes()) if t.is_valid else np.zeros(0, np.int64) for t in b.column(text_col)[a : a + 500]]))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(np.concatenate(out) if out else np.zeros(0))], schema_names)

    names = docs.columns
    schema_names = [*names, name]
    return docs.mapInArrow(lean(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double")


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    machine = train(docs, labels)
    found = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), machine)
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels), name="_toxicity").filter(F.col("_toxicity") < threshold).select(docs.columns)
