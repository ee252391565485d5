"""Faults that the third look at round two's findings found, each on rows that showed it."""

from __future__ import annotations

import random

import pytest

from lexmill.llm import simhash


def edited(seed: int, sizes: list[int], n: int, counts: list[int]) -> list[str]:
    """``n`` texts, each made of the passages of ``sizes`` words, some left out at times, with
    one of ``counts`` words replaced."""
    rnd = random.Random(seed)
    parts = [[f"p{k}w{i}" for i in range(size)] for k, size in enumerate(sizes)]
    out = []
    for i in range(n):
        words = [w for k, p in enumerate(parts) if k == 0 or rnd.random() < 0.5 for w in p]
        for at in rnd.sample(range(len(words)), rnd.choice(counts)):
            words[at] = f"x{rnd.randrange(40 if i % 3 else 10**6)}"
        out.append(" ".join(words))
    return out


def shingled(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return simhash.shingle_sets(rows, "doc_id", "text", 5).withColumnRenamed("doc_id", "node")


def groups(pairs, n: int) -> list[int]:
    root = list(range(n))
    for a, b in pairs:
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)
    for i in range(n):
        root[i] = root[root[i]]
    return root


@pytest.mark.parametrize(("sizes", "counts"), [([150], [0, 1, 2, 3, 4, 6]), ([80, 15, 25], [0, 0, 1, 2, 3])])
def test_edits_to_a_head_find_all_that_pairs_find(spark, monkeypatch, sizes, counts):
    """Keys of any size by edits, against all pairs."""
    monkeypatch.setattr(simhash, "CROWDED", 1)
    monkeypatch.setattr(simhash, "SAMPLE", 2)
    texts = list(dict.fromkeys(edited(len(sizes), sizes, 150, counts)))
    sets = [set(simhash._packed(simhash.shingle_hashes(t, 5)).tolist()) for t in texts]
    close = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    found = [tuple(r) for r in simhash.similar_edges(shingled(spark, texts), 0.8).collect()]
    assert groups(found, len(sets)) == groups(close, len(sets))
    assert {(max(p), min(p)) for p in found} <= set(close)


def test_every_similar_pair_with_a_head_is_tied_or_met():
    """Whatever set is the head: both are similar to it, or they show a common edit in their roles."""
    import numpy as np

    texts = list(dict.fromkeys(edited(7, [60, 12], 160, [0, 1, 2, 3, 5])))
    sets = [simhash._packed(simhash.shingle_hashes(t, 5)) for t in texts]
    common = (np.sort(sets[0]), np.arange(len(sets[0]))[::-1].copy())
    met = 0
    for head in sets[::23]:
        told = []
        for x in sets:
            near, grams, lesser, greater = simhash._edits(x, head, common, 0.8)
            told.append((near, len(grams) - len(x) / 9, set(grams[:lesser].tolist()), set(grams[:greater].tolist())))
        for i, x in enumerate(sets):
            for j in range(i):
                inner = len(np.intersect1d(x, sets[j]))
                if inner / (len(x) + len(sets[j]) - inner) >= 0.8 and not (told[i][0] and told[j][0]):
                    small, large = sorted((told[i], told[j]), key=lambda t: t[1])
                    assert small[2] & large[3] or small[1] == large[1] and small[3] & large[2]
                    met += 1
    assert met


def test_near_copies_that_stay_apart_are_not_all_compared(spark, monkeypatch):
    """Many copies of a passage with four words of their own are alike to the passage, not to each other."""
    rnd = random.Random(3)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(400):
        words = list(base)
        for at in rnd.sample(range(5, 145, 6), 4 if i else 0):
            words[at] = f"x{i}x{at}"
        texts.append(" ".join(words))
    compared = []
    passing = simhash._passing
    monkeypatch.setattr(simhash, "_passing", lambda pairs, *rest: compared.append(pairs.count()) or passing(pairs, *rest))
    assert simhash.similar_edges(shingled(spark, texts), 0.8).count() == 0
    assert sum(compared) < 20 * len(texts)


def test_sentence_index_splits_each_text_once(spark, tmp_path):
    """Once into sentences, once each chunk: no filter before the explode computes them again."""
    from lexmill.plans import QUERIES

    said = [(1, "One is here. " * 400 + "Two is there."), (2, ""), (3, None), (4, "Alone")]
    spark.createDataFrame(said, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["sentence_index"](spark, str(tmp_path)).where("doc_id > 0")
    assert {r.doc_id for r in out.collect()} == {1, 4}
    plan = QUERIES["sentence_index"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "size(flatten" not in plan and "size(transform" not in plan
