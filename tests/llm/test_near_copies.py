"""Near copies against brute force over all pairs of shingle sets."""

import random

import pytest
from test_operators import words

from txweave.llm import near_copies


def plain_sets(texts):
    out = []
    for t in texts:
        w = [x.lower() for x in words(t)]
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    return out


def plain_groups(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def edited():
    """Texts with copies of up to so many changed words, chains of copies, and none."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", "one two", "One  two"]
    for n in (60, 200, 400):
        for changes in (1, 2, 4, 6, 12):
            t = [word() for _ in range(n)]
            for _ in range(4):  # each a copy of the one before: ends of the chain are further apart
                texts.append(" ".join(t))
                t = list(t)
                for _ in range(changes):
                    t[rng.randrange(n)] = word()
    return texts


def crowd():
    """A large group around one text, from close copies to ones beyond 0.8 of most others."""
    rng = random.Random(12)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(160):
        t = list(base)
        for _ in range(k % 11):
            t[rng.randrange(len(t))] = f"x{rng.randrange(40)}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize(("texts", "most"), [(edited(), 4096), (crowd(), 4096), (crowd(), 9)])
def test_near_copies_equal_brute_force(spark, texts, most):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    roots = plain_groups(plain_sets(texts))
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs, most).collect()} == dict(enumerate(roots))
    assert sorted(r.doc_id for r in near_copies.one_of_each(docs).collect()) == sorted(set(roots))


@pytest.mark.parametrize("rows", [[], [(None, "a b"), (None, "a b"), (3, "A b")]])
def test_rows_without_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in near_copies.one_of_each(docs).collect()] == [3][: len(rows)]


def test_the_pipeline_drops_near_copies(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(200)]
    other = [*base[:100], "changed", *base[101:]]
    docs = spark.createDataFrame([(0, " ".join(base)), (1, " ".join(other)), (2, "something else here")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [0, 2]
