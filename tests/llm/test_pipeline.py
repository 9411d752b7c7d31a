"""The pipeline's stages on small tables, each held against its operator or brute force on its own input."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from cityloom.llm import jaccard, mixing, packing, secrets, toxicity
from cityloom.llm.common import settled, table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(settled(stage(spark, out[-1], SF), re.sub(r"\W", "-", name)))
    return out


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxicity(spark, steps):
    model = toxicity.fitted(steps[0], table(spark, SF, "labels"))
    scores = toxicity.scored(steps[0], model, ["doc_id"]).toPandas()
    assert sorted(steps[1].toPandas().doc_id) == sorted(scores.doc_id[scores.predicted == 0])


def test_near_copies(steps):
    before = steps[1].toPandas()
    comp = jaccard.jaccard_components(steps[1], 5, 80).toPandas()
    sets = {}
    for i, t in zip(before.doc_id, before.text, strict=True):
        w = [x.encode().lower() for x in words(t)]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = dict(zip(comp.doc_id, comp.component_id, strict=True))
    ids = list(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            if 100 * len(x & y) >= 80 * len(x | y):
                assert label[ids[a]] == label[ids[b]]
    assert sorted(steps[2].toPandas().doc_id) == sorted(comp.doc_id[comp.doc_id == comp.component_id])


def test_secrets(steps):
    got = dict(steps[3].select("doc_id", "text").collect())
    for r in steps[2].collect():
        base = secrets.base_spans(r["text"])
        assert (secrets.MASK in got[r["doc_id"]]) >= bool(base)
        assert not secrets.base_spans(got[r["doc_id"]]) or base
    assert len(got) == steps[2].count()


def test_mixing(steps):
    took = mixing.taken_parts(steps[3], ["doc_id"]).selectExpr("doc_id", "aggregate(parts, 0L, (a, p) -> a + (p.hi - p.lo) * p.times) as n").toPandas()
    got = Counter()
    for r in steps[4].select("doc_id", "text").collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == Counter({i: n for i, n in zip(took.doc_id, took.n, strict=True) if n})


def test_packing(steps):
    got = steps[5].toPandas()
    want = packing.cut_pieces(steps[4], packing.vocabulary_path()).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, got[key].values.tolist())) == Counter(map(tuple, want[key].values.tolist()))
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == g.length.cumsum() - g.length).all() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() <= got.length.sum() // 4096 + 2


def test_run(spark, steps):
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == Counter(map(tuple, steps[5].select("doc_id", "piece", "ids_crc32").collect()))
