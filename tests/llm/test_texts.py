"""Operators on texts against brute force, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm import common, components, op1_substring, op2_bpe, op4_quality, op6_simhash, op8_mixing, op9_tokens, rangecoder

WORD = re.compile("[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_word_bounds():
    texts = ["", " a", "b ", "cc  dd\n", "\t", "e"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    starts, ends, n = common.word_bounds(raw, offsets)
    assert [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)] == ["a", "b", "cc", "dd", "e"]
    assert n.tolist() == [0, 1, 1, 2, 0, 1]
    h = common.word_hashes(raw, starts, ends)
    assert len(set(h.tolist())) == 5


def cut_by_hand(data, least=35):
    words = [WORD.findall(t or "") for _, t in data]
    seen = Counter(tuple(w[i : i + least]) for w in words for i in range(len(w) - least + 1))
    out = []
    for (i, _), w in zip(data, words):
        gone = set()
        for k in range(len(w) - least + 1):
            if seen[tuple(w[k : k + least])] > 1:
                gone |= set(range(k, k + least))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [2, 35])
def test_substring_odd(odd, odd_rows, least):
    found = op1_substring.remove_repeats(odd, least=least)
    assert rows(found, "id", "n_words", "n_removed", "kept") == cut_by_hand([r[:2] for r in odd_rows], least)


def test_substring_documents(spark, documents):
    data = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows(op1_substring.remove_repeats(documents), "id", "n_words", "n_removed", "kept") == cut_by_hand(data)


def test_substring_overlapping_within_one(spark):
    text = "a b " * 40
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows(op1_substring.remove_repeats(df), "id", "n_words", "n_removed", "kept") == cut_by_hand([(1, text)])


def test_substring_carries(odd):
    found = op1_substring.remove_repeats(odd, carry=["lang", "source"], as_it_was=True)
    assert {(r.id, r.lang, r.source) for r in found.collect()} == {(r.doc_id, r.lang, r.source) for r in odd.collect()}
    kept = {r.id: r.kept for r in found.collect() if not r.n_removed and r.id}
    assert kept[12] == "a\tb\x0bc\r\nd  e" and kept[2] is None


def test_bpe(odd, odd_rows):
    t = Tokenizer.from_file(op2_bpe.word_file())
    want = []
    for i, text, *_ in odd_rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((i, ids, t.decode(ids, skip_special_tokens=False)))
    found = op2_bpe.encode(odd, op2_bpe.word_file(), decoded=True)
    assert rows(found, "id", "ids", "text") == sorted(want, key=repr)
    again = found.select("id", op2_bpe.decode(op2_bpe.word_file())(F.col("ids")).alias("text"))
    assert rows(again, "id", "text") == sorted(((i, x) for i, _, x in want), key=repr)


def test_bpe_small_chunks(odd, odd_rows, monkeypatch):
    monkeypatch.setattr(op2_bpe, "CHUNK_BYTES", 50)
    t = Tokenizer.from_file(op2_bpe.word_file())
    found = op2_bpe.encode(odd, op2_bpe.word_file())
    assert rows(found, "id", "ids") == sorted(((i, t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in odd_rows), key=repr)


def test_bpe_query(documents):
    t = Tokenizer.from_file(op2_bpe.word_file())
    want = []
    for r in documents.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    assert rows(op2_bpe.digests(documents), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def by_hand(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(data):
    """data: (id, fingerprint). The smallest id reachable; null ids are no names."""
    fps = sorted({f for _, f in data})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for i, f in data:
        if i is not None:
            low[find(f)] = min(low.get(find(f), i), i)
    return sorted(((i, f, low.get(find(f))) for i, f in data), key=repr)


def test_simhash_odd(odd, odd_rows):
    found = op6_simhash.near_duplicates(odd)
    have = sorted(((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in found.collect()), key=repr)
    assert have == groups_by_hand([(i, by_hand(t)) for i, t, *_ in odd_rows])


@pytest.mark.parametrize("direct", [1, 3, 1024])
def test_hamming_links(spark, monkeypatch, direct):
    monkeypatch.setattr(op6_simhash, "DIRECT", direct)
    rng = np.random.default_rng(6)
    base = [int(x) for x in rng.integers(0, 2**63, 12)] + [0, (1 << 64) - 1]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    joined = {r.node: r.component for r in components.components(op6_simhash.links(df)).collect()}
    parts = {}
    for x in signed:
        parts.setdefault(joined.get(x, x), set()).add(x & (1 << 64) - 1)
    want = {}
    for i, f, c in groups_by_hand([(i, f) for i, f in enumerate(sorted(fps))]):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, parts.values())) == sorted(map(sorted, want.values()))


def test_keep_one(odd):
    kept = op6_simhash.keep_one(odd)
    assert kept.columns == odd.columns
    names = [c for c in odd.columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
    assert all(r[c] == f"clash {c}" for r in kept.collect() for c in names)


def kept_by_hand(data):
    """data: (id, text). The ids that stay: of each component by brute force the smallest, null only where there is no other."""
    texts = [(k, by_hand(t)) for k, (_, t) in enumerate(data)]
    ids = {}
    for k, _, component in groups_by_hand(texts):
        ids.setdefault(component, []).append(data[k][0])
    return sorted((min((i for i in x if i is not None), default=None) for x in ids.values()), key=repr)


def test_keep_one_of_each_component(spark, odd, odd_rows):
    assert sorted((r.doc_id for r in op6_simhash.keep_one(odd).collect()), key=repr) == kept_by_hand([r[:2] for r in odd_rows])
    texts = [" ".join(f"{t}{i}" for i in range(30)) for t in "abcde"]
    data = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (5, texts[2]), (9, texts[2]), (5, texts[3]), (12, texts[3]), (None, texts[3]), (7, texts[4])]
    kept = op6_simhash.keep_one(spark.createDataFrame(data, "doc_id long, text string"))
    assert rows(kept, "doc_id", "text") == sorted([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (7, texts[4])], key=repr)


@pytest.mark.parametrize("size", [3, 50])
def test_probes_pass_by(monkeypatch, size):
    """A key whose probes fill many batches, and keys that end with a batch: the pairs are those of brute force."""
    monkeypatch.setattr(op6_simhash, "SLICE", 4)
    rng = np.random.default_rng(3)
    data = []
    for key in range(30):
        base = int(rng.integers(0, 2**62))
        members = [base] + [base ^ (1 << int(b)) for b in rng.integers(0, 60, rng.integers(0, 4))]
        asked = [base ^ (1 << int(b)) ^ (1 << int(c)) for b, c in rng.integers(0, 60, (200 if key % 7 == 0 else rng.integers(0, 3), 2))]
        data += [(key, x, False) for x in dict.fromkeys(members)] + [(key, x, True) for x in asked]
    table = pa.table({"key": [d[0] for d in data], "fp": [d[1] for d in data], "probe": [d[2] for d in data]})
    linked = set()
    for out in op6_simhash._verify(2)(iter(table.to_batches(size))):
        linked |= set(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    def roots(edges):
        root = {x: x for _, x, _ in data}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in edges:
            root[find(a)] = find(b)
        groups = {}
        for x in root:
            groups.setdefault(find(x), set()).add(x)
        return sorted(map(sorted, groups.values()))
    every = {(a, b) for k, a, p in data if not p for j, b, _ in data if j == k and (a ^ b).bit_count() <= 2}
    assert roots(linked) == roots(every)


def test_components_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(5)
    found = {r.node: r.component for r in components.components(edges).collect()}
    assert found == {i: 0 for i in range(1, n + 1)} | {1001: 1000}


def test_quality(spark, sf_dir, odd, none):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/labels.parquet")
    model = op4_quality.train(docs, labels)
    found = op4_quality.score(docs, model, keys=["doc_id"]).join(labels, "doc_id").collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and sum((r.score >= 0.3) == (r.quality == 1) for r in held) / len(held) > 0.95
    scores = op4_quality.score(odd, model, keys=["doc_id", "text"])
    assert scores.count() == odd.count() and all(0 <= r.score <= 1 for r in scores.collect())
    assert op4_quality.score(none, model, keys=["doc_id"]).count() == 0
    assert op4_quality.score(odd.drop("n_chars"), model, keys=["doc_id"]).count() == odd.count()
    untrained = op4_quality.train(none, labels)
    assert {round(r.score, 6) for r in op4_quality.score(odd, untrained, keys=["doc_id"]).collect()} == {0.5}
    one = op4_quality.train(docs, labels.where("quality = 1"))
    assert all(r.score > 0.5 for r in op4_quality.score(odd, one, keys=["doc_id"]).collect())


def test_factorisation_identity():
    rng = np.random.default_rng(8)
    m = op4_quality.Model(0.3, rng.normal(size=12), rng.normal(size=(12, 3)), np.ones(12))
    x = rng.normal(size=12)
    want = 0.3 + m.weight @ x + sum(m.factor[i] @ m.factor[j] * x[i] * x[j] for i in range(12) for j in range(i))
    assert np.isclose(m.raw(np.zeros(12, int), np.arange(12), x, 1)[0], want)


def mixed(df, **more):
    return [r.asDict() for r in op8_mixing.mix(df, **more).collect()]


def test_mix(odd, odd_rows):
    found = mixed(odd)
    assert len(found) == len(odd_rows)
    by = {}
    for r in found:
        by.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in found)
    assert total == sum(len(WORD.findall(t or "")) for _, t, *_ in odd_rows)
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None])}
    sizes = {s: sum(r["size"] for r in x) for s, x in by.items()}
    targets, left = {}, set(by)
    while left:
        rest = 1.5 * total - sum(targets.values())
        share = {s: rest * weights[s] / sum(weights[k] for k in left) for s in left}
        full = {s for s in left if share[s] > 2 * sizes[s]}
        if not full:
            targets |= share
            break
        targets |= {s: 2.0 * sizes[s] for s in full}
        left -= full
    for s, x in by.items():
        assert all(abs(r["target"] - targets[s]) < 1e-6 and r["source_size"] == sizes[s] for r in x)
        assert targets[s] - 1 - len(x) <= sum(r["taken"] for r in x) <= targets[s] + 1e-6
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in x)
    key = lambda r: (repr(r["doc_id"]), r["size"], r["taken"])
    assert sorted(map(key, found)) == sorted(map(key, mixed(odd.repartition(5))))


def test_mix_carries(odd):
    assert sorted(repr(r["lang"]) for r in mixed(odd, carry=["lang"])) == sorted(repr(r.lang) for r in odd.collect())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65534), max_size=400), st.integers(1, 70))
def test_range_coder(ids, length):
    ids = np.array(ids, np.int64)
    frame = rangecoder.Frame.of(ids)
    again = rangecoder.Frame.from_bytes(frame.to_bytes())
    assert np.array_equal(rangecoder.decode(rangecoder.encode(ids, length, frame), again), ids)


@pytest.mark.parametrize("most", [1, 7, 4096])
def test_range_coder_frames(monkeypatch, most):
    """Contexts with few and many successors, more of them than places, and ids seen once."""
    monkeypatch.setattr(rangecoder, "CONTEXTS", most)
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.repeat(3, 5000), rng.integers(0, 3000, 60_000), np.tile(np.arange(50), 400), rng.zipf(1.3, 50_000) % 65_536, np.stack([np.full(9000, 9), rng.integers(0, 1500, 9000)], 1).ravel()])
    frame = rangecoder.Frame.of(ids)
    contexts, _, entries, _, freqs, _, all_freqs = frame.parts
    assert all(f.sum() == 1 << 10 and f.min() >= 1 for f in np.split(freqs, np.cumsum(entries)[:-1])) and all_freqs.sum() == 1 << 16 and len(contexts) <= most
    assert np.array_equal(rangecoder.decode(rangecoder.encode(ids, 999, frame), rangecoder.Frame.from_bytes(frame.to_bytes())), ids)


def test_range_coder_learns_and_checks():
    ids = np.tile(np.arange(50), 400)
    frame = rangecoder.Frame.of(ids)
    blocks = rangecoder.encode(ids, 5000, frame)
    assert sum(map(len, blocks)) < len(ids) // 20
    assert np.array_equal(rangecoder.decode(blocks[2:3], frame), ids[10000:15000])  # a block alone
    for at in (0, 5, len(blocks[1]) - 1):
        bad = bytearray(blocks[1])
        bad[at] ^= 4
        with pytest.raises(ValueError, match="checksum"):
            rangecoder.decode([blocks[0], bytes(bad)], frame)


def test_token_files_are_small(sf_dir):
    """Fewer bits an id than general compressors on blocks of the same size, and than the entropy of single ids, frequencies included."""
    texts = pq.read_table(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet", columns=["text"]).column("text").combine_chunks()
    ids, n = op9_tokens.token_ids(texts, BYTES)
    none = np.zeros(len(n), np.int64)
    bits = 8 * len(op9_tokens.frame_of(none, none, n, ids)) / len(ids)
    size = min(op9_tokens.LONGEST, -(-len(ids) // op9_tokens.ABREAST))
    parts = [ids[a : a + size].astype("<u2").tobytes() for a in range(0, len(ids), size)]
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert bits < 8 * sum(len(zlib.compress(x, 6)) for x in parts) / len(ids) * 0.75
    assert bits < 8 * sum(len(zstandard.compress(x, 3)) for x in parts) / len(ids) * 0.75
    assert bits < -(share * np.log2(share)).sum()


BYTES = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab \n\t é'.1", "<|endoftext|>", "don't"]), max_size=30).map("".join), max_size=5))
def test_token_ids(texts):
    t = Tokenizer.from_file(BYTES)
    ids, n = op9_tokens.token_ids(pa.array(texts, pa.string()), BYTES)
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for e, k in zip(ends, n)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_token_files(spark, odd, odd_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(op9_tokens, "FRAME_IDS", 40)
    op9_tokens.write(odd, f"file://{tmp_path}/t", BYTES)
    found = op9_tokens.read(spark, f"file://{tmp_path}/t").collect()
    t = Tokenizer.from_file(BYTES)
    want = sorted(((i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x, *_ in odd_rows), key=repr)
    assert sorted(((r.id, r.ids) for r in found), key=repr) == want
    found.sort(key=lambda r: r.start)
    start = 0
    for r in found:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    ids = [r.id for r in found if r.id is not None]
    assert ids == sorted(ids) and found[0].id is None


def test_empty_tables(spark, none, tmp_path):
    assert op1_substring.remove_repeats(none).count() == 0
    assert op2_bpe.encode(none, op2_bpe.word_file(), decoded=True).count() == 0
    assert op6_simhash.near_duplicates(none).count() == 0
    assert op6_simhash.keep_one(none).count() == 0
    assert op8_mixing.mix(none).count() == 0
    op9_tokens.write(none, f"file://{tmp_path}/t", BYTES)
    assert op9_tokens.read(spark, f"file://{tmp_path}/t").count() == 0
