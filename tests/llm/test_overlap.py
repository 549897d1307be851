"""Near copies by Jaccard similarity against brute force."""

import re

import corpus_pipeline
import numpy as np
import pytest

from keyloom.llm import overlap


def _set(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


@pytest.mark.parametrize("frequent", [4, 2])
def test_near_copies(spark, frequent, monkeypatch):
    monkeypatch.setattr(overlap, "FREQUENT", frequent)
    rng = np.random.default_rng(6)
    words = lambda n: [f"w{x}" for x in rng.integers(0, 3000, n)]
    passage, texts = words(40), ["", None, " ", "one two", "One TWO"]
    for k in range(30):
        base = words(int(rng.integers(30, 300))) + (passage if k % 2 else [])
        for edits in (0, 1, 1, 2, 3, 5, 8):
            own = list(base)
            for at in rng.integers(0, len(own), edits):
                own[at] = f"e{rng.integers(0, 10**9)}"
            texts.append(" ".join(own))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    sets = [_set(t) for t in texts]
    root, far = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 10 * both >= 8 * len(sets[i] | sets[j]):
                far += 10 * both < 9 * len(sets[i] | sets[j])
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert far > 20
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*set(root), None], key=str)
    assert corpus_pipeline.near_copies(spark, docs.limit(0), "").count() == 0


def _tried(monkeypatch):
    """The pairs that each confirmation gets."""
    calls, confirmed = [], overlap._confirmed
    monkeypatch.setattr(overlap, "_confirmed", lambda pairs, *a: calls.append([tuple(r) for r in pairs.select("a", "b").collect()]) or confirmed(pairs, *a))
    return calls


def test_what_the_trie_has_joined_is_not_joined_again(spark, monkeypatch):
    rng, calls = np.random.default_rng(7), _tried(monkeypatch)
    base = [f"w{x}" for x in rng.integers(0, 3000, 120)]
    texts = [" ".join([*base[: 10 * k], f"e{k}", *base[10 * k + 1 :]]) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    star = [(k, 5) for k in range(5)]
    classes = overlap.near_pair_classes(docs, reached=lambda table: spark.createDataFrame(star, "a long, b long"))
    assert sorted(map(tuple, classes.collect())) == [(k, 0) for k in range(6)]
    assert sorted(calls[0]) == star and not any(calls[1:])
    calls.clear()
    part = overlap.near_pair_classes(docs, reached=lambda table: spark.createDataFrame(star[:3], "a long, b long"))
    assert sorted(map(tuple, part.collect())) == [(k, 0) for k in range(6)]
    assert sorted(calls[0]) == star[:3] and all(b in (3, 4) for c in calls[1:] for _, b in c) and any(calls[1:])


def test_a_group_that_links_in_many_ways_does_not_give_all_of_its_pairs(spark, monkeypatch):
    rng, calls = np.random.default_rng(8), _tried(monkeypatch)
    base, texts = [f"w{x}" for x in rng.integers(0, 3000, 300)], []
    for k in range(150):
        own = list(base)
        for at in rng.integers(0, 300, 2 + k % 4):
            own[at] = f"e{rng.integers(0, 10**9)}"
        texts.append(" ".join(own))
    sets, root, links = [_set(t) for t in texts], list(range(150)), 0
    for i in range(150):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root, links = [a if r == b else r for r in root], links + 1
    assert links > 2000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.node: r.component for r in overlap.near_pair_classes(docs).collect()}
    assert [got.get(k, k) for k in range(150)] == root
    assert sum(map(len, calls)) < 1000
