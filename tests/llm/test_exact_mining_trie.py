"""Exact dedup, hard negatives and the prefix trie against brute force on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from comparing import numbers, rows_of, rows_of_sql
from rasterloom.llm import op11_exact, op12_negatives, op13_trie
from rasterloom.llm import queries as llm


def groups_by_hand(rows):
    """rows: (id, text). (id, keep_id, group_size, kept, sha), each group keeping one row of its smallest id."""
    plain = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    of = defaultdict(list)
    for i, t in rows:
        of[plain(t)].append(i)
    out = []
    for t, ids in of.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), at == 0, hashlib.sha256(t.encode()).hexdigest()) for at, i in enumerate(ids)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"chunk_bytes": 300, "bucket_bytes": 20_000}, {"chunk_bytes": 1, "bucket_bytes": 100_000}])
def test_exact_groups(spark, odd, odd_rows, sizes):
    """With small chunks and buckets, records are spilled over several levels and copies meet in parts."""
    found = op11_exact.exact_groups(odd, **sizes)
    assert sorted(map(tuple, found.collect()), key=repr) == groups_by_hand([r[:2] for r in odd_rows])


def test_hot_copies(spark):
    """A third of all rows are one text, some are near it, and one very long text has many copies."""
    rng = random.Random(1)
    rows = [(i, "the same  text") for i in range(400)] + [(400 + i, f"the same text {i % 7}") for i in range(400)]
    rows += [(800 + i, "".join(rng.choices("abc \n", k=50))) for i in range(400)] + [(2000 + i, "long " * 4000) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = op11_exact.exact_groups(df, chunk_bytes=20, bucket_bytes=5000)
    assert sorted(map(tuple, found.collect()), key=repr) == groups_by_hand(rows)


def test_deduplicated_keeps_whole_rows(spark, odd, odd_rows):
    found = op11_exact.deduplicated(odd)
    assert found.columns == odd.columns
    want = Counter(r[0] for r in groups_by_hand([r[:2] for r in odd_rows]) if r[3])
    assert Counter(r.doc_id for r in found.collect()) == want


def test_table_compares_whole_texts():
    table = op11_exact.Texts()
    numbers_of = [table.place(5, b"text %d" % (i % 300)) for i in range(900)]  # all with one hash
    assert numbers_of == [i % 300 for i in range(900)] and table.place(6, b"text 1") == 300


def test_exact_empty(spark, none):
    assert op11_exact.exact_groups(none).count() == 0 and op11_exact.deduplicated(none).count() == 0


def negatives_by_hand(anchors, rows, positives=5, negatives=5):
    good = lambda r: r[0] is not None and r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1])
    whole = lambda rs: [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rs if good((i, v, label))]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out, rows = [], whole(rows)
    for a, label, v in whole(anchors):
        scored = [(-dot(v, w), i, k) for i, k, w in rows if len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label and x[1] != a)[:positives]:
            fit = sorted(x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)
            out += [(a, p, r, i, -s, -t) for r, (t, i, _) in enumerate(fit[:negatives], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(4, 12))
    rows = [(i, (centres[i % 4] + rng.normal(size=12) * 0.2).tolist(), int(i * 7 % 3)) for i in range(150)]
    rows += [(200 + i, rows[4][1], i % 2) for i in range(60)]  # one vector is very common
    rows += [(300, [0.0] * 12, 1), (310, None, 1), (320, rows[0][1], None), (330, [1.0, None] + [0.0] * 10, 1), (340, [float("nan")] * 12, 0), (350, [float("inf")] * 12, 0), (360, [1.0, 2.0], 1), (370, [2.0, 4.0], 1), (371, [1.5, 3.0], 0)]
    rows += [(380, [], 0), (None, rows[0][1], 0), (20, rows[21][1], 2), (20, rows[20][1], rows[20][2]), (390, [-x for x in rows[0][1]], 0), (400, [1e6] * 12, 1), (401, [1e6] * 12, 1), (402, [0.9e6] * 12, 0), (410, [1e-3] * 12, 9)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 7, "GROUP": 9}])
def test_hard_negatives(spark, labelled, monkeypatch, sizes):
    for name, n in sizes.items():
        monkeypatch.setattr(op12_negatives, name, n)
    df = spark.createDataFrame(labelled, "vec_id long, embedding array<double>, label int").repartition(3)
    df = df.withColumns({c: F.lit("x") for c in ("id", "v", "dim", "ids", "labels", "vals", "block", "line", "p", "score", "rank")})
    found = op12_negatives.hard_negatives(df.where("vec_id % 10 = 0"), df)
    assert sorted(map(tuple, found.collect())) == negatives_by_hand([r for r in labelled if r[0] is not None and r[0] % 10 == 0], labelled)


def test_best_is_mergeable():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 30, (4, 500)), rng.permutation(500)
    fits = rng.random((4, 500)) < 0.7
    want = [sorted((-s, i) for s, i, f in zip(scores[r], ids, fits[r], strict=True) if f)[:5] for r in range(4)]
    for cut in ([0, 500], [0, 3, 250, 251, 500], list(range(501))):
        best = op12_negatives.Best(4, 5)
        for a, b in zip(cut, cut[1:], strict=False):
            best.add(np.arange(4), scores[:, a:b].astype(float), fits[:, a:b], ids[a:b])
        assert [list(zip(-best.scores[r], best.ids[r], strict=True)) for r in range(4)] == want


def test_products_beyond_doubles():
    a, b = np.array([[2**30, 3]]), np.array([[2**31, 1], [-(2**30), 7]])
    assert op12_negatives.products(a, b).tolist() == [[2**61 + 3, 21 - 2**60]]
    assert op12_negatives.products(a // 2**20, b // 2**20).dtype == np.float64


def test_negatives_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert op12_negatives.hard_negatives(none, none).count() == 0


def trie_by_hand(rows):
    """rows: (conv, turn, role, text), ties in the order given."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {}
    for c in turns:
        turns[c] = [t[2:] for t in sorted(turns[c], key=lambda t: t[:2])]
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        hub = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        seqs[c] = tuple(turns.get(hub, [])[:h]) + tuple(own[h:])
    of, ends = defaultdict(set), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            of[s[:d]].add(c)
        ends[s].append(c)
    kids, leaves, saved = Counter(k[:-1] for k in of if k), Counter(), Counter()
    for k in of:
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(of[k]) - 1) * len(k[-1][1]) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted(((min(of[k]), len(k), min(of[k[:-1]]) if k else None, len(of[k]), kids[k], leaves[k], saved[k], sha(k)) for k in of), key=repr)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(9)
    words = ["yes", "no", "", None, "é x", "long " * 300]
    rows = []
    for c in [*range(0, 60), *range(100, 130), 205, 206, 333, -5, -100, -107]:
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for t in range(rng.randrange(1, 9))]
    rows += [(400 + i, t, "user", f"turn {t}") for i in range(80) for t in range(12)]  # a very common conversation
    rows += [(1000, t, "user", f"on and on {t % 5}") for t in range(600)]  # one with a third of all turns
    rows += [(1001 + i, t, "user", f"on and on {t % 5}") for i in range(6) for t in range(5 + 40 * i)]  # and some that leave it one after the other
    rows += [(7, None, "system", "first"), (None, 0, "user", "of nobody"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("spread", [1, 16])
def test_trie(spark, talks, monkeypatch, spread):
    monkeypatch.setattr(op13_trie, "partitions", lambda s: spread)
    df = spark.createDataFrame(talks, "conv_id long, turn long, role string, text string").repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("conv", "h1", "h2", "cp", "part", "i", "depth", "k1", "low", "n", "head", "hub", "first", "ids", "up")})
    found = op13_trie.prefix_trie(df)
    assert sorted(map(tuple, found.collect()), key=repr) == trie_by_hand(talks)


def test_trie_rows_alike(spark):
    """Turns with one number: rows alike are turns of their own, and their order doesn't depend on how they lie."""
    rows = [(c, 1, "user", "same") for c in (8, 9) for _ in range(9)] + [(c, 2, "user", t) for c in (8, 9) for t in ("a", "b", "c")]
    found = [op13_trie.prefix_trie(spark.createDataFrame(r, "conv_id long, turn long, role string, text string")) for r in (rows, rows[::-1])]
    a, b = (sorted(map(tuple, f.collect()), key=repr) for f in found)
    assert a == b and max(r[1] for r in a) >= 9
    assert [r[2:] for r in a if r[1] == 0] == [(None, 2, *r[4:]) for r in a if r[1] == 0]


def test_trie_empty(spark):
    assert op13_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert op13_trie.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op12_hard_negatives", "op13_prefix_trie"])
def test_query(spark, oracle, sf_dir, name):
    assert numbers(rows_of(llm.QUERIES[name](spark, sf_dir))) == numbers(rows_of_sql(oracle, llm.ORACLES[name]))
