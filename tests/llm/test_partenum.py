"""Candidate pairs of the near-duplicate join: few where many texts share a passage, and none lost that link."""

import itertools
import random

import numpy as np
import pyarrow as pa

from ledgerline.llm import partenum
from ledgerline.llm.words import word_slices

MEMBERS = "cls long, n int, coarse array<short>, pivot long, root long"
GROUPS = "gid long, cls long, needed boolean"


def test_classes_of_one_signature_with_distant_sketches_do_not_meet(spark):
    rng = np.random.default_rng(4)
    sketches = [rng.integers(0, 4, partenum.COARSE).tolist() for _ in range(40)]
    sketches[1] = list(sketches[0])
    sketches[1][5] += 1
    members = [(k, sum(s), s, 100 + k, k) for k, s in enumerate(sketches)]
    groups = [(7, k, True) for k in range(40)] + [(8, 0, False), (8, 1, False)]
    found = partenum._across_pivots(spark.createDataFrame(groups, GROUPS), spark.createDataFrame(members, MEMBERS)).collect()
    assert [tuple(r) for r in found] == [(0, 1)]
    spared = [(7, k, k != 1) for k in range(40)]
    assert not partenum._across_pivots(spark.createDataFrame(spared, GROUPS), spark.createDataFrame(members, MEMBERS)).count()


def test_linked_classes_share_a_signature_that_both_need(spark):
    rng = random.Random(8)

    def words(n):
        return [f"w{rng.randrange(10**6)}" for _ in range(n)]

    passage = words(60)
    texts = [passage[: rng.randrange(50, 61)] + words(rng.randrange(0, 40)) for _ in range(60)]
    for k in range(40):
        text = list(texts[k % 8])
        for _ in range(k % 3):
            text[rng.randrange(len(text))] = words(1)[0]
        texts.append(text)
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    classes = docs.mapInArrow(partenum._classes, partenum.CLASSES).select("cls", "spare_own", "spare_next")
    rows = partenum._groups(docs, classes).collect()
    every, needed = {}, {}
    for r in rows:
        every.setdefault(r.cls, set()).add(r.gid)
        if r.needed:
            needed.setdefault(r.cls, set()).add(r.gid)
    column = pa.array([" ".join(t) for t in texts])
    sets = {partenum.set_class(f): f for w in word_slices(column) for f in partenum.shingle_sets(w)}
    links = apart = 0
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        both = len(np.intersect1d(x, y))
        if 100 * both >= 75 * (len(x) + len(y) - both):
            links += 1
            assert needed.get(a, set()) & needed.get(b, set())
        else:
            apart += bool(every.get(a, set()) & every.get(b, set())) - bool(needed.get(a, set()) & needed.get(b, set()))
    assert links > 100 and apart > 100
