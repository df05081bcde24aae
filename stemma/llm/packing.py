"""Best-fit packing of token pieces into fixed-length sequences by exact-complement hashing.

Documents are tokenised, ended with an end id and cut into pieces of at most `capacity`
tokens. Packing needs only the histogram of piece lengths (at most `capacity` entries,
whatever the corpus), so the plan is made on the driver and is small: sums of one, two and
three available lengths are looked up to fill each gap exactly, consuming as many copies of
a combination at once as its counts allow; what remains goes best-fit decreasing. A plan is a
list of patterns (lengths in a sequence, how many such sequences). Pieces then find their
place by their rank within their length; ranks come from counts by hash bucket, so that a
length held by a third of all pieces is still spread over many tasks.

Tokenising goes word by word where the tokenizer never joins characters across ASCII white
space, so that a text's ids are the ids of its words in order, and words repeat; each task
asks its tokenizer about that and keeps a cache of some 2 * CACHE_WORDS words (80 MB), the longest unused going first.

Defined results: a null or empty text is one piece holding the end id; equal texts are packed
separately; an empty table packs nothing; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stemma.storage import lean, stored

CAPACITY = 4096
CACHE_WORDS = 200_000
BLOCK_BYTES = 4 << 20
PER_BUCKET = 4000

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


#: Kinds of bytes: ASCII letters, ASCII punctuation, the first byte of Latin-1 letters, ASCII white space; the rest is 0.
_LETTER, _PUNCTUATION, _LEAD, _SPACE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
for _kind, _of in ((_LETTER, string.ascii_letters), (_PUNCTUATION, string.punctuation), (_LEAD, "\u00c3"), (_SPACE, string.whitespace)):
    _KIND[list(_of.encode("latin-1"))] = _kind
#: The letters of plain words, in lower case.
_CORE = re.compile(rb"(?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++").fullmatch
#: So many words go to the tokenizer at once.
BATCH_WORDS = 20_000
#: What a tokenizer must agree on with itself before its words are taken one by one.
_PROBES = ["It's a test, isn't it?! (Really) 42.5% of \u00c9T\u00c9s\u2026 #tag \u00fcber-gro\u00dfz\u00fcgig", "\u03a3\u0391\u03a3 \u0130x e\u0301 \u00e9 n\u0303andu 'S 't x's a'b ''s", "word... %%% $$$word word*** -- a_b c\\d \u4e2d\u6587\u3002 \U0001f600ok", "A.B.C d/e/f 0641917ea4 <b>x</b> \u00d7\u00f7 \u00aa\u00ba\u00b5"]


def _byte_letters() -> dict[int, str]:
    """The visible character by which byte-level tokenizers write each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def plainly(data: np.ndarray) -> np.ndarray:
    """Where plain words of data (bytes of texts) go over from letters to punctuation; their letters are put in lower case.

    A plain word is one run of the Latin-1 letters, which no normalisation joins or splits, and then
    ASCII punctuation or none, between ASCII white space."""
    kind = _KIND[data]
    lead = np.flatnonzero(kind[:-1] == _LEAD)
    second = data[lead + 1]
    of = (second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)  # not the signs for times and divided by
    lead, second = lead[of], second[of]
    kind[lead] = kind[lead + 1] = _LETTER
    starts = np.flatnonzero(np.concatenate(([True], kind[:-1] == _SPACE)))  # of words, empty ones too: each with the white space after it
    odd = (kind == 0) | (kind == _LEAD)
    odd[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _PUNCTUATION)
    plain = np.repeat(~np.logical_or.reduceat(odd, starts) & (kind[starts] != _PUNCTUATION), np.diff(starts, append=len(data)))
    data[(data >= 0x41) & (data <= 0x5A) & plain] += 0x20
    data[lead[(second <= 0x9E) & plain[lead]] + 1] += 0x20
    return np.flatnonzero((kind[1:] == _PUNCTUATION) & (kind[:-1] == _LETTER) & plain[1:]) + 1


class WordTokenizer:
    """ids of texts as little-endian bytes.

    Where the tokenizer gives for texts what it gives for their words (it is asked about _PROBES),
    words are taken one by one and cached; a plain word's letters go to the merges without the tokenizer's
    normalisation and splitting, and its punctuation is a word, if that too agrees. Otherwise whole texts are encoded."""

    def __init__(self, json: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.of = Tokenizer.from_str(json)
        self.of.no_truncation()
        self.known = {b"": b""}  # and what was known before it last grew full
        self.before: dict[bytes, bytes] = {}
        self.letters = {b: c for b, c in _byte_letters().items() if b != 0x20}
        self.merges = Tokenizer(self.of.model)  # the merges alone, of words between spaces
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab, suffix = self.of.get_vocab(), getattr(self.of.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that only a word's last characters get
        self.ends[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        cores = ["word", "Stra\u00dfe", "\u00c9T\u00c9", "na\u00efve", "ing", "x"]
        self.by_core = self._cores([w.lower().encode() for w in cores]) == [self._whole(w) for w in cores]
        words = [w for p in _PROBES for w in p.split()]
        probes = [*_PROBES, " ".join(words), *words]
        self.by_word = list(self._by_words([p.encode() for p in probes])) == [self._whole(p) for p in probes]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.of.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cores(self, cores: list[bytes]) -> list[bytes]:
        """Of lower-case runs of Latin-1 letters, by the merges alone; empty if it is not plain where each ends.

        A word has one id with the suffix at most, so as many of these as words tell each word's last."""
        out: list[bytes] = []
        for a in range(0, len(cores), BATCH_WORDS):
            part = cores[a : a + BATCH_WORDS]
            text = b" ".join(part).decode("latin-1").translate(self.letters)
            ids = np.asarray(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            at = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            if len(at) != len(part) or at[-1] != 4 * len(ids):
                return []
            data, at = ids.tobytes(), [0, *at.tolist()]
            out += [data[x:y] for x, y in zip(at, at[1:])]
        return out

    def learn(self, words: list[bytes]) -> None:
        """Have all of these distinct words in self.known."""
        if len(self.known) > CACHE_WORDS:
            self.known, self.before = {b"": b""}, self.known
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        known.update((w, before[w]) for w in new if w in before)
        odd = [w for w in new if w not in before]
        if self.by_core:
            cores = [w for w in odd if _CORE(w)]
            got = self._cores(cores)
            if len(got) == len(cores):
                known.update(zip(cores, got))
                odd = [w for w in odd if w not in known]
        for a in range(0, len(odd), BATCH_WORDS):
            part = [w.decode() for w in odd[a : a + BATCH_WORDS]]
            e = self.of.encode(" ".join(part), add_special_tokens=False)
            first = np.array([x for x, _ in e.offsets], np.int64)
            at = 4 * np.searchsorted(first, np.cumsum([0, *(len(w) + 1 for w in part)]))
            data = np.asarray(e.ids, "<u4").tobytes()
            known.update(zip(odd[a : a + BATCH_WORDS], (data[x:y] for x, y in zip(at.tolist(), at[1:].tolist()))))

    def encode_all(self, texts: list[bytes]) -> Iterator[bytes]:
        if self.by_word:
            yield from self._by_words(texts)
        else:
            yield from (self._whole(t.decode()) for t in texts)

    def _by_words(self, texts: list[bytes]) -> Iterator[bytes]:
        data = np.frombuffer(bytearray(b"\n".join([*texts, b""])), np.uint8)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        if self.by_core and len(data):
            gaps = plainly(data)
            data = np.insert(data, gaps, 0x20)
            bounds += np.searchsorted(gaps, bounds)
        joined = pa.StringArray.from_buffers(len(texts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data))
        split = pc.ascii_split_whitespace(joined)  # gives empty words at the ends
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        self.learn(words)
        ids = [self.known[w] for w in words]
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, first = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        size, first = size[which], first[which]
        ends = np.cumsum(size)
        at = np.repeat(first - ends + size, size)
        at += np.arange(len(at))
        data = table[at].tobytes()
        bounds = (4 * np.concatenate(([0], ends))[split.offsets.to_numpy()]).tolist()
        for a, b in zip(bounds, bounds[1:]):
            yield data[a:b]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """PIECE_SCHEMA rows (with_ids: and the ids). tokenizer: the file, read here and sent to the executors (some MB)."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = WordTokenizer(sent.value)  # for this task: the worker keeps no cache for the stages after it
        ids, texts, size = [], [], 0

        def done() -> pa.RecordBatch:
            rows: list[list] = [[], [], [], [], [], []]
            for d, data in zip(ids, tok.encode_all(texts)):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    for to, v in zip(rows, (d, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        to.append(v)
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(r, t) for r, t in zip(rows, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<i4") for x in rows[5]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names)

        for b in batches:
            for d, t in zip(b.column(0), b.column(1)):
                ids.append(d.as_py())
                texts.append(t.as_buffer().to_pybytes() if t.is_valid else b"")
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield done()
                    ids, texts, size = [], [], 0
        if ids:
            yield done()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(cut), PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """[(((length, times), ...), sequences), ...] holding every length as often as the histogram says.

    Small lengths spent on completions are missing in best fit: of the plans with complements of up
    to three, two and one lengths, each looked up in full, that of the fewest sequences is taken."""
    return min((_plan(histogram, capacity, parts) for parts in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(histogram: dict[int, int], capacity: int, parts: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out: list[tuple[tuple[tuple[int, int], ...], int]] = []

    def use(*lengths: int) -> bool:
        """As many sequences of these lengths as their counts allow; False if none."""
        times = {x: lengths.count(x) for x in lengths}
        n = int(min(left[x] // k for x, k in times.items()))
        if n:
            for x, k in times.items():
                left[x] -= n * k
            out.append((tuple(sorted(times.items(), reverse=True)), n))
        return n > 0

    if left[capacity]:
        use(capacity)

    def enough(*lengths: int) -> bool:
        return all(left[x] >= lengths.count(x) for x in lengths)

    def completion(big: int) -> tuple[int, ...] | None:
        """At most `parts` lengths up to big that are left beside it and fill its gap; the largest first."""
        gap = capacity - big
        if gap <= big and enough(big, gap):
            return (gap,)
        if parts < 2:
            return None
        have = left[: big + 1] > 0  # the index of single lengths
        a = np.arange(max((gap + 1) // 2, gap - big), min(gap - 1, big) + 1)
        for x in a[have[a] & have[gap - a]][::-1].tolist():
            if enough(big, x, gap - x):
                return x, gap - x
        if parts < 3:
            return None
        seen = np.fft.rfft(have, 2 * size)
        pairs = np.fft.irfft(seen * seen, 2 * size) > 0.5  # that of pair sums
        a = np.arange(max(1, gap - 2 * big), min(gap - 2, big) + 1)
        for x in a[have[a] & pairs[gap - a]][::-1].tolist():
            rest = gap - x
            b = np.arange(max((rest + 1) // 2, rest - big), min(rest - 1, big) + 1)
            for y in b[have[b] & have[rest - b]][::-1].tolist():
                if enough(big, x, y, rest - y):
                    return x, y, rest - y
        return None

    size = 1 << capacity.bit_length()
    for big in range(capacity - 1, 0, -1):
        if (parts + 1) * big < capacity:  # so many lengths up to big cannot fill the gap; longer ones had their turn
            break
        while left[big] and (rest := completion(big)):
            use(big, *rest)
    # best-fit decreasing on the residuals; open sequences are held by their gap
    by_gap: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    gaps: list[int] = []

    def put(gap: int, pattern, n: int) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            bisect.insort(gaps, gap)
        by_gap[gap].append((pattern, n))

    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            k = bisect.bisect_left(gaps, length)
            if k == len(gaps):
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, ((length, each),), n // each)
                if n % each:
                    put(capacity - n % each * length, ((length, n % each),), 1)
                break
            gap = gaps[k]
            pattern, m = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap], gaps[k]
            each = min(gap // length, n)
            took = min(m, n // each)
            put(gap - each * length, (*pattern, (length, each)), took)
            if m > took:
                put(gap, pattern, m - took)
            n -= took * each
    return out + [(p, n) for held in by_gap.values() for p, n in held]


def _ranked(df: DataFrame, key: str, tie: list[str], rows: int) -> DataFrame:
    """df with `rank`: 0, 1, ... within key, by hash bucket and then tie; no task gets a whole key."""
    spread = int(min(4096, max(8, rows // PER_BUCKET)))
    df = df.withColumn("_b", F.pmod(F.xxhash64(*tie), F.lit(spread)).cast("int"))
    counts = df.groupBy(key, "_b").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), before.alias("_base"))
    df = df.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(*tie)))
    return df.join(base, (df[key] == base["_k"]) & (df["_b"] == base["_kb"])).withColumn("rank", F.col("_base") + F.col("_r") - 1).drop("_b", "_k", "_kb", "_base", "_r")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (a stored table with doc_id, piece, length) with sequence_id and offset."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    rows = sum(histogram.values())
    used = dict.fromkeys(histogram, 0)
    places: list[tuple[int, int, int, int, int]] = []  # length, first rank, times, first sequence, offset
    seq = 0
    for pattern, n in plan(histogram, capacity):
        at = 0
        for length, times in pattern:
            places.append((length, used[length], times, seq, at))
            used[length] += n * times
            at += length * times
        seq += n
    places.sort()
    table = np.array(places, np.int64).reshape(-1, 5)
    sent = cut.sparkSession.sparkContext.broadcast(table)
    names = cut.columns

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        span = 1 << 48
        keys = t[:, 0] * span + t[:, 1]
        for b in batches:
            length, rank = (b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("length", "rank"))
            r = t[np.searchsorted(keys, length * span + rank, "right") - 1]
            inside = rank - r[:, 1]
            cols = [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r[:, 3] + inside // np.maximum(r[:, 2], 1)), pa.array(r[:, 4] + inside % np.maximum(r[:, 2], 1) * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id bigint, offset bigint"
    return _ranked(cut, "length", ["doc_id", "piece", "ids_crc32"], rows).mapInArrow(lean(find), schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    return place(stored(pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
