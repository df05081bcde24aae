"""Each operator against a plain version, on rows with nulls, blanks, repeats, ties, long texts and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stemma.llm import chat, decontaminate, licenses, packing, pivots, shards, similar, simhash, suffix, toxicity, urls
from stemma.llm.queries import QUERIES, RULES, tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, score string, key string"


def texts():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé.Z") for _ in range(rng.randint(1, 6)))
    say = lambda n: " ".join(word() for _ in range(n))
    shared = [say(70) for _ in range(4)]
    out = [None, "", " \n\t ", "x" * 199, "x" * 200, "x" * 201, "one two", "<|endoftext|> It's ΣΑΣ İx a.b, 'S", shared[0], shared[0], shared[0] + " end", say(6000)]
    return out + [" ".join(rng.choice([say(rng.randint(0, 60)), rng.choice(shared)]) for _ in range(rng.randint(1, 4))) for _ in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", 1, "i", None, "k") for i, t in enumerate(texts())] + [(8, texts()[8], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(docs):
    return [(r.doc_id, (r.text or "")) for r in docs.select("doc_id", "text").collect()]


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def test_suffix(docs, empty):
    rows = [(d, t.encode()) for d, t in rows_of(docs)]
    seen = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    want = []
    for d, b in rows:
        hit = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                hit[i : i + 200] = b"\1" * 200
        want.append((d, len(b), sum(hit), sum(1 for i in range(len(b)) if hit[i] and not (i and hit[i - 1])), hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    assert sorted(tuple(r) for r in suffix.removal(docs).collect()) == sorted(want)
    assert suffix.strip(docs).columns == docs.columns and suffix.strip(docs).count() == docs.count()
    assert suffix.removal(empty).count() == 0


def test_suffix_frequent_keys(docs):
    """Salted keys and collections dealt anew by windows find the same strings."""
    def places(**how):
        return {(r["id"], r["mark"]): suffix._merged(r["places"]) for r in suffix.spans(docs, **how).collect()}

    plain = places(share=1, hot=1 << 40)
    assert plain and plain == places(share=1, hot=2) == places(share=2, hot=3) == places(share=1, hot=2, giant=1)


def test_suffix_external_columns(docs, monkeypatch):
    args = (np.array([0, 0, 1]), np.array([1, 1, 2]), np.array([0, 1, 0]), [b"abcdef", b"bcdefg", b"zzzzz"], 8, 4)
    inside = suffix.repeats(*args)
    monkeypatch.setattr(suffix, "MEMORY", 0)
    assert (suffix.repeats(*args) == inside).all() and inside[1, 0] and inside[1, 1] and inside[0, 2] and not inside[0, 0]


def test_simhash(docs, empty):
    from xxhash import xxh64_intdigest

    def fp(t):
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        h = [xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))

    rows = [(d, fp(t)) for d, t in rows_of(docs)]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group) if h == g) for g in group}
    want = sorted((d, format(f, "016x"), least[g]) for (d, f), g in zip(rows, group))
    for bucket in (simhash.BUCKET, 1):  # 1: every bucket is dealt anew by ball centres
        assert sorted(tuple(r) for r in simhash.groups(docs, bucket=bucket).collect()) == want
    kept = simhash.firsts(docs, simhash.groups(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values())) and kept.columns == docs.columns
    assert simhash.groups(empty).count() == 0


def test_near_duplicates(spark, docs, empty, monkeypatch):
    """The pipeline's stage against all pairs' exact similarity, with copies on both sides of 0.8."""
    rng = random.Random(8)
    rows = [(d, t) for d, t in rows_of(docs)]
    for _ in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([4, 9, 60, 300]))]
        for edits in (0, 0, 1, 2, 3, 6):
            w = list(base)
            for k in rng.sample(range(len(w)), min(len(w), edits * len(w) // 60 + (edits > 0))):
                w[k] = "edited"
            rows.append((1000 + len(rows), " ".join(w)))

    def bag(t):
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    bags = [bag(t) for _, t in rows]
    group = list(range(len(rows)))
    linked = 0
    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                linked += 0.8 <= len(a & b) / max(1, len(a | b)) < 0.95
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    least = {g: min(r[0] for r, h in zip(rows, group) if h == g) for g in group}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(set(least.values()))
    assert linked > 10
    for few, stars, sampled in ((similar.FEW, similar.STARS, similar.SAMPLED), (2, 2, 4), (2, 0, 1)):
        monkeypatch.setattr(similar, "FEW", few)
        monkeypatch.setattr(similar, "STARS", stars)
        monkeypatch.setattr(similar, "SAMPLED", sampled)
        assert sorted({r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}) == want
    assert similar.keep_one(docs).columns == docs.columns and similar.keep_one(empty).count() == 0


@pytest.mark.parametrize("least", [0, 1])
def test_near_duplicates_one_large_group(spark, monkeypatch, least):
    """Edited copies of one text, about half of them beyond 0.8 of all others, with and without the text itself: pairs do not grow with the group's square."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = [(i, " ".join(w if k not in cut else f"x{rng.randrange(10**6)}" for k, w in enumerate(base))) for i in range(600) for cut in [set(rng.sample(range(150), least + i % 8))]]
    bags = [{" ".join(w[k : k + 5]) for k in range(146)} for _, t in rows for w in [t.split()]]
    group = list(range(len(rows)))
    for i, a in enumerate(bags):
        for j, b in enumerate(bags[:i]):
            if group[i] != group[j] and 10 * len(a & b) >= 8 * len(a | b):
                x, y = group[i], group[j]
                group = [y if g == x else g for g in group]
    want = {g: min(i for i, h in enumerate(group) if h == g) for g in set(group)}
    assert 200 < len(want) < 500
    pairs = Counter()
    kept = similar.stored

    def counted(df, name):
        out = kept(df, name)
        if name.endswith("pairs"):
            pairs[name] += out.count()
        return out

    monkeypatch.setattr(similar, "stored", counted)
    got = similar.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == [(i, want[group[i]]) for i in range(len(rows))]
    assert pairs["large_pairs"] < len(rows) and sum(pairs.values()) < 6 * len(rows), pairs


def test_parity():
    """Sets differ in at least as many hashes as their parities in bits, whatever their sizes; a few differences count in full or nearly."""
    rng = np.random.default_rng(6)
    for n, m in ((0, 0), (0, 1), (3, 3), (200, 30), (5000, 5000)):
        both, a, b = (rng.integers(-(1 << 63), (1 << 63) - 1, size) for size in (500, n, m))
        x, y = (np.unique(np.concatenate([both, own])) for own in (a, b))
        bits = int(np.bitwise_count((similar._parity(x) ^ similar._parity(y)).view(np.uint64)).sum())
        assert bits <= n + m and (bits - n - m) % 2 == 0 and (n + m > 10 or bits >= n + m - 2)


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for d, t in rows_of(docs):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 64)):
            part = ids[a : a + 64]
            want.append((d, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    got = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    for s in {r.sequence_id for r in got}:
        at = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert len({r.sequence_id for r in got}) <= 1.02 * sum(r.length for r in got) / 64 + 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_packing_words():
    """Case and punctuation after it make no new words of a plain word; ids are those of whole texts."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    with open(tokenizer_path(), encoding="utf-8") as f:
        words = packing.WordTokenizer(f.read())
    known = len(words.known)
    plain = ["zebra zebra, Zebra ZEBRA; zebra,", " Éclair!\néclair ÉCLAIR,\t", "", " "]
    odd = ["a.b 'S (x) x--y ÀÖØÞßÿ× É÷é ªb eH\u0331 H\u0331, <|endoftext|> <|ENDOFTEXT|>, c\u00a0d\x1ce x\u0338 <\u0338 ΣΑΣ, İ. 4,5 .", "!", "\x00", "a,b c,", ",", "ß?ß"]
    for texts in (plain, odd, [], plain + odd):
        assert list(words.encode_all([t.encode() for t in texts])) == [np.array(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        if texts is plain:
            assert words.known.keys() >= {b"zebra", "éclair".encode()} and len(words.known) <= known + 5  # these and the three marks


@pytest.mark.parametrize("histogram, want", [({1100: 30, 1000: 60, 996: 30}, 30), ({3000: 5, 400: 5, 396: 5, 300: 5} | dict.fromkeys(range(1000, 1091), 4), None), ({1024: 9}, 3), ({1366: 10, 1365: 20}, 10), ({2048: 3, 1: 1}, 2)])
def test_packing_completions(histogram, want):
    """Complements are found whatever the largest length and however many lengths lie below the gap."""
    plan = packing.plan(histogram)
    held = Counter()
    for pattern, n in plan:
        assert sum(x * k for x, k in pattern) <= 4096
        held.update({x: k * n for x, k in pattern})
    assert +held == Counter(histogram)
    if want is None:
        assert (((3000, 1), (400, 1), (396, 1), (300, 1)), 5) in packing._plan(histogram, 4096, 3)
    else:
        assert sum(n for _, n in plan) == want


def test_shards(docs, empty):
    got = shards.shard(docs, 5).collect()
    texts_of = dict(rows_of(docs))
    assert len(got) == docs.count() and all(r.size == len(texts_of[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts_of[r.doc_id].encode()) for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts_of[r.doc_id], r.shard) == r.shard
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert shards.shard(empty, 5).count() == 0


@pytest.mark.parametrize("classes", [[(10, 1000), (500, 3), (7, 41)], [(9000, 2), (300, 500), (299, 7), (8, 3000)], [(8, 1)], [(100, 97), (60, 96), (33, 95)]])
def test_shards_schedule(classes):
    """Each group is dealt once, and loads are those of scheduling item by item."""
    import heapq

    runs = sorted(shards.schedule([(c, n, c * n) for c, n in classes], 4))
    loads = [0] * 4
    for (c, first, s), after in zip(runs, [*runs[1:], (None, 0, 0)]):
        loads[s] += c * ((after[1] if after[0] == c else dict(classes)[c]) - first)
    heap = [0] * 4
    for c, n in sorted(classes, reverse=True):
        for _ in range(n):
            heapq.heapreplace(heap, heap[0] + c)
    assert sum(loads) == sum(heap) and max(loads) <= max(heap) + max(8, min(c for c, _ in classes))


@pytest.mark.parametrize("piece", [decontaminate.PIECE_BYTES, 10])
def test_decontamination(spark, docs, empty, monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
    some = [t for _, t in rows_of(docs) if len(t.split()) > 20]
    items = [(1, some[0]), (2, "One TWO"), (3, None), (4, ""), (5, " ".join(some[1].split()[3:15])), (5, "one two"), (6, "never seen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(t or ""))
    windows = [(i, w[k : k + 10]) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - 9)) if w]
    want = []
    for d, t in rows_of(docs):
        w, hit, found = words(t), set(), set()
        for i, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit.update(range(k, k + len(x)))
                    found.add(i)
        want.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit)))
    for rows in (docs, docs.repartition(4)):  # rows that a shuffle may bring in any order
        assert sorted(tuple(r) for r in decontaminate.digest(decontaminate.matches(rows, bench)).collect()) == sorted(want)
    assert decontaminate.matches(empty, bench).count() == 0
    assert decontaminate.digest(decontaminate.matches(docs, bench.limit(0))).filter("contaminated").count() == 0
    near = spark.createDataFrame([(9, "two one")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.digest(decontaminate.matches(docs, near, near=1)).filter("contaminated").collect()} == {6}


@pytest.mark.parametrize("piece", [decontaminate.PIECE_BYTES, 10])
def test_decontamination_without_item_id(spark, monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", piece)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "c d x"), (3, "y")], "doc_id long, text string")
    for items, found in (([(None, "b c")], {1: (2, 0), 2: (0, 0), 3: (0, 0)}), ([(None, "b c"), (7, "c d"), (None, "c d")], {1: (3, 1), 2: (2, 1), 3: (0, 0)})):
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = decontaminate.digest(decontaminate.matches(docs, bench)).collect()
        assert {r.doc_id: (r.n_hit, r.n_items) for r in got} == found and all(r.contaminated == (r.n_hit > 0) for r in got)
    assert [r.doc_id for r in decontaminate.clean(docs, bench).collect()] == [3]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "e") for i in range(300)] + [(i, [1.0] * 6, "e") for i in range(300, 340)]
    rows += [(20, [float(x) for x in rng.normal(size=6)], "e"), (40, rows[40][1], "e"), (41, rows[41][1], "e")]  # ids that repeat
    rows += [(400, None, "n"), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0], "n"), (440, [float("nan")] * 6, "n"), (460, [1.0, 2.0], "short"), (461, [1.0, 2.0], "short"), (None, [1.0] * 6, "n")]
    v = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x, k in rows if k != "n"]
    want = []
    for a, (q, x) in enumerate(v):
        if q % 20 == 0:
            best = sorted((-int(x @ y), c) for b, (c, y) in enumerate(v) if a != b and len(x) == len(y))[:7]
            want += [(q, k + 1, c, -s) for k, (s, c) in enumerate(best)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, pivot string")
    got = pivots.top_k(df, F.col("id") % 20 == 0, k=7, annulus=16, chunk=5)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert pivots.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_k_stops(spark, monkeypatch):
    """On clusters far apart no round follows the last annulus that may still matter."""
    rng = np.random.default_rng(7)
    at = 100 * np.eye(8)[np.arange(800) % 8]
    v = at + 0.05 * rng.normal(size=at.shape)
    rounds = []
    kept = pivots.stored
    monkeypatch.setattr(pivots, "stored", lambda df, name: (rounds.append(name), kept(df, name))[1])
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    got = pivots.top_k(df, F.col("id") % 20 == 0, k=5, annulus=10, chunk=1).collect()
    x = np.floor(64 * v).astype(int)
    want = [(q, k + 1, c, -s) for q in range(0, 800, 20) for k, (s, c) in enumerate(sorted((-int(x[q] @ x[c]), c) for c in range(800) if c != q)[:5])]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert rounds.count("round") < 4  # all annuli: 3 + 24 + 192


def test_top_k_own_annulus(spark):
    """A query whose whole top k lies in its own annulus, which holds more than k rows."""
    rng = np.random.default_rng(5)
    near = np.array([40.0, 0, 0, 0]) + 0.2 * rng.normal(size=(30, 4))
    far = 5 * rng.normal(size=(60, 4))
    far[0] = [-200, 0, 0, 0]  # the largest norm: raised to it, the near ones stay near
    v = np.floor(64 * np.concatenate([near, far])).astype(int)
    want = [(q, k + 1, c, -s) for q in range(0, 90, 20) for k, (s, c) in enumerate(sorted((-int(v[q] @ v[c]), c) for c in range(90) if c != q)[:7])]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(np.concatenate([near, far]))], "vec_id long, embedding array<double>")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)  # ranges end annuli too
    try:
        got = pivots.top_k(df, F.col("id") % 20 == 0, k=7, annulus=100, chunk=5)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def _linear(rows, labels, held):
    """Share of the held-out rows that a fitted linear score of single terms puts on the right side of its best threshold."""
    terms = sorted({int(x) for r in rows for x in r})
    x = np.array([[t in set(r.tolist()) for t in terms] + [1] for r in rows], float)
    w = np.linalg.lstsq(x[~held], labels[~held], rcond=None)[0]
    s = x @ w
    return max(np.mean((s[held] >= t) == labels[held]) for t in np.unique(s))


@pytest.mark.parametrize("rule", [lambda bad, group: bad and group, lambda bad, group: bad != group])
def test_toxicity(spark, docs, empty, rule):
    """An insult with a group mention; either of two words alone, which no linear score of single terms can tell."""
    rng = random.Random(2)
    rows = []
    for i in range(600):
        bad, group = rng.random() < 0.5, rng.random() < 0.5
        w = [rng.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(20)] + ["insultx"] * bad + ["groupy"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w), int(rule(bad, group))))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = {r.doc_id: r for r in toxicity.judged(df.select("doc_id", "text"), df.select("doc_id", "toxic")).collect()}
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert {i for i in got if got[i].held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 4 == 2}
    right = np.mean([p == y for p, y in held])
    assert right > 0.95
    if rule(False, True):
        terms = toxicity.Terms()
        assert _linear([terms.features(t.encode()) for _, t, _ in rows], np.array([y for *_, y in rows]), np.array([got[i].held_out for i, *_ in rows])) < 0.8
    none = toxicity.judged(docs.select("doc_id", "text"), df.limit(0).select("doc_id", "toxic"))
    assert none.filter("score between 0 and 1").count() == docs.count() and none.filter("predicted = 1").count() == 0
    kept = toxicity.keep_clean(docs, df.select("doc_id", "toxic"))
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert toxicity.judged(empty, df.select("doc_id", "toxic")).count() == 0


def test_urls(spark):
    pages = [None, "no scheme", "http://A.Example.NET/en/x?q", "http://example.net/de/", "http://example.com/de/#f", "https://xexample.com/de/", "http://b.org/fr/", "http://b.org", "x://net/", "a://b.net/p://c.org/fr/", "http://n-et/", "http:///en/"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(pages)] + [(2, pages[2], "h")], "page_id long, url string, host string")

    def judge(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[1:] if fit else (None, "allow")))

    want = sorted((i, *judge(u)) for i, u, _ in df.collect())
    assert sorted(tuple(r) for r in urls.judge(df, RULES).collect()) == want
    assert {r.verdict for r in urls.judge(df, RULES[:0] or spark.createDataFrame([], "host string, path string, verdict string")).collect()} == {"allow"}
    assert urls.judge(df.limit(0), RULES).count() == 0


def test_chat(spark):
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    rows = [(1, t(("user", "q"), ("assistant", "yes")), t(("user", "q"), ("assistant", "no!"))), (2, t(("user", "q")), t(("user", "q"))), (3, None, t(("assistant", None))), (4, t((None, "a")), t(("", "a")))]
    got = {r.pair_id: r for r in chat.preferences(spark.createDataFrame(rows, "pair_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")).collect()}
    a = got[1]
    assert (a.n_common, a.prompt, a.chosen, a.chosen_mask, a.rejected_mask) == (1, "<|user|>\nq\n", "<|assistant|>\nyes\n", "14-17", "14-17") and a.chosen[14:17] == "yes"
    assert got[2].n_common == 1 and got[2].chosen == "" and got[3].prompt == "" and got[3].rejected_mask == "14-14" and got[4].n_common == 0
    conv = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "x"), (2, 0, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert {r.pair_id: r.rejected for r in chat.preferences(chat.with_next_answers(conv)).collect()} == {1: "<|assistant|>\ny\n", 2: "<|assistant|>\n\n"}
    assert chat.preferences(chat.with_next_answers(conv.limit(0))).count() == 0


def test_licenses(spark):
    rows = [(1, "a/b/c.txt", "many words of code here\nReleased under the MIT License.\nand more of it there"), (2, "a/LICENSE", "Licensed under CC BY-NC 4.0."), (3, "a/b/d/e.txt", "plain"), (4, "z/e.txt", None), (5, None, "words"), (6, "a/x.txt", "")]
    got = {r.doc_id: (r.license, r.effective, r.from_directory) for r in licenses.scan_tree(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("MIT", "MIT", None), 2: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None), 3: (None, "CC-BY-NC-4.0", "a"), 4: (None, None, None), 5: (None, None, None), 6: (None, "CC-BY-NC-4.0", "a")}
    assert licenses.scan_tree(spark.createDataFrame(rows, "doc_id long, path string, text string").limit(0)).count() == 0


def test_license_texts(spark):
    """Whole licence texts, wrapped; notices that wrap behind comment marks; repeated rows, ties, long texts, columns with clashing names."""
    import textwrap

    body = {n: t for n, t in licenses.TEMPLATES if len(t) > 300}
    wrap = lambda t: "Copyright (c) 2021 Jo Doe. All rights reserved.\n\n" + "\n".join(textwrap.wrap(t, 70))
    rng = random.Random(4)
    prose = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30_000))
    go = "// Copyright 2019 The Authors.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file.\n\npackage x\n"
    rows = [(i, f"{n}/LICENSE", wrap(t), "x") for i, (n, t) in enumerate(sorted(body.items()))] + [(10 + i, f"{n}/src/deep/a.c", "int x;", "x") for i, n in enumerate(sorted(body))]
    rows += [(20, "g/a.go", go + prose, "x"), (21, "g/b.go", prose, "x"), (22, "p/LICENSE", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS\n" + prose, "x"), (23, "p/q/r", "", "x"), (24, "t/a", "Released under the MIT License.", "x"), (24, "t/a", "Released under the MIT License.", "x")]
    got = {}
    for r in licenses.scan_tree(spark.createDataFrame(rows, "doc_id long, path string, text string, license string")).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.effective, r.from_directory))
    for i, n in enumerate(sorted(body)):
        assert got[i] == [(n, n, None)] and got[10 + i] == [(None, n, n)]
    assert got[20] == [("BSD-3-Clause", "BSD-3-Clause", None)] and got[21] == [(None, None, None)]
    assert got[22] == [("Apache-2.0", "Apache-2.0", None)] and got[23] == [(None, "Apache-2.0", "p")] and got[24] == [("MIT", "MIT", None)] * 2


def test_pipeline(spark):
    assert len(QUERIES) == 10 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "suffix_dedup", "decontamination", "packing"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, d = d, stage(spark, d, SF)
        assert d.columns == before.columns and d.select("doc_id").exceptAll(before.select("doc_id")).isEmpty()
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == {r.doc_id for r in d.select("doc_id").collect()}
