"""The pipeline and the registered queries."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from comparing import numbers, rows_of, rows_of_sql
from test_texts import WORD, cut_by_hand, groups_by_hand, kept_by_hand
from test_texts import by_hand as fingerprint_by_hand
from tokenizers import Tokenizer

from rasterloom.llm import op4_quality, op8_mixing


def test_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    sizes = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        docs = p.materialise(stage(spark, docs, sf_dir))
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2]
    assert p.STAGES[-1][1](spark, docs, sf_dir).count() == sizes[4]
    assert p.run(spark, sf_dir).count() == sizes[4]


def score_by_hand(model, text, n_chars):
    """Bias, weights and the sum over pairs of features, for one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    _, name, value = op4_quality.features(raw, np.array([0, len(raw)]), np.array([-1 if n_chars is None else n_chars]))
    x = value * model.scale[name]
    vx = model.factor[name] * x[:, None]
    pairs = (vx[1:] * np.cumsum(vx, 0)[:-1]).sum()  # each feature with all before it
    return 1 / (1 + np.exp(-(model.bias + model.weight[name] @ x + pairs)))


def held(df, *names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_stages_by_hand(spark, sf_dir, request, table):
    """What each stage returns, as a plain version of its decision gives it for its own input."""
    import corpus_pipeline as p

    docs = request.getfixturevalue(table)
    stages = dict(p.STAGES)
    apply = lambda name: p.materialise(stages[name](spark, docs, sf_dir))

    model = op4_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    every = docs.collect()
    kept = apply("quality classifier")
    scores = [(r.doc_id, r.text, score_by_hand(model, r.text, r.n_chars)) for r in every]
    assert all(abs(s - 0.3) > 1e-6 for *_, s in scores)
    assert held(kept, "doc_id", "text") == Counter((i, t) for i, t, s in scores if s >= 0.3)
    assert table == "odd" or len(every) > kept.count() > 0
    docs = kept if table == "documents" else docs  # odd rows go on whole

    every = docs.collect()
    kept = apply("SimHash near-dedup")
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows), key=repr) == kept_by_hand([(r.doc_id, r.text) for r in every])
    assert not Counter((r.doc_id, r.text) for r in rows) - Counter((r.doc_id, r.text) for r in every)
    groups = groups_by_hand([(k, fingerprint_by_hand(r.text)) for k, r in enumerate(rows)])
    assert len({g for *_, g in groups}) == len(rows)
    docs = kept if table == "documents" else docs

    every = docs.collect()
    kept = apply("substring dedup")
    cut = Counter()
    texts = {}
    for i, n, gone, left in cut_by_hand([(k, r.text) for k, r in enumerate(every)]):
        texts[i] = left if gone else every[i].text
    for k, r in enumerate(every):
        cut[r.doc_id, texts[k], len(texts[k]) if texts[k] is not None else None, r.lang, r.source] += 1
    assert held(kept, "doc_id", "text", "n_chars", "lang", "source") == cut
    docs = kept

    every = docs.collect()
    found = op8_mixing.mix(docs.select("doc_id", "text", "source"), carry=["text"]).collect()
    want = Counter()
    for r in found:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        if r["size"]:
            want[r["doc_id"], r["text"]] += int(r["taken"] / r["size"] + 0.5)
    kept = apply("source mix")
    assert held(kept, "doc_id", "text") == +want
    words = lambda rows: Counter({s: sum(len(WORD.findall(r.text or "")) for r in rows if r.source == s) for s in {r.source for r in rows}})
    mixed, sizes = words(kept.collect()), words(every)
    assert all(n <= 2 * sizes[s] for s, n in mixed.items())
    docs = kept

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), zlib.crc32(repr(ids).encode()), t.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.n_tokens, zlib.crc32(repr(list(r.ids)).encode()), r.decoded) for r in stages["BPE"](spark, docs, sf_dir).collect()) == want


def test_odd_rows(spark, sf_dir, odd):
    import corpus_pipeline as p

    for _, stage in p.STAGES:
        assert stage(spark, odd, sf_dir).count() > 0
        assert stage(spark, odd.limit(0), sf_dir).count() == 0


def oracles():
    from rasterloom.llm.queries import ORACLES

    return sorted(ORACLES)


@pytest.mark.parametrize("name", oracles())
def test_sql(spark, oracle, sf_dir, name):
    from rasterloom.llm.queries import ORACLES, QUERIES

    assert numbers(rows_of(QUERIES[name](spark, sf_dir))) == numbers(rows_of_sql(oracle, ORACLES[name]))


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
