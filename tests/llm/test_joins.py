"""Operators 1 and 5 beside brute force."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from brindle.llm import embedding_join, ngram_join, shared

from .conftest import words


def components_of(links: dict) -> dict:
    root = {i: i for i in links}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, others in links.items():
        for j in others:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in links}


def shingles(text: str) -> set:
    w = text.encode().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows: list[tuple]) -> dict:
    sets = [shingles(t or "") for _, t in rows]
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a].add(b)
    return links


def copies(seed: int) -> list[tuple]:
    """A large group of near copies, exact copies, short texts and single ones."""
    rng = random.Random(seed)
    base, rows = words(rng, 120), []
    for _ in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(10**6))
        rows.append(" ".join(w))
    rows += [" ".join(base)] * 40 + ["a b c", "a b c", "a b", "", "  "] + [" ".join(words(rng, 80)) for _ in range(60)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("block", "crowd"), [(8, 8), (64, 2), (2048, 1000)])
def test_op1(spark, block, crowd):
    rows = copies(5)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, class_id long").repartition(7)
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs, block=block, crowd=crowd).collect()}
    links = brute(rows)
    named = components_of(links)
    assert got == {i: (named[i], len(links[i])) for i, _ in rows}


def test_op1_odd_rows(spark, odd_docs):
    found = ngram_join.ngram_jaccard_join(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_id = defaultdict(list)
    for r in found:
        by_id[r["doc_id"]].append((r["class_id"], r["n_links"]))
    assert by_id[None] == [(None, 0)] and by_id[90] == [(90, 0)] and by_id[0] == [(0, 0)]
    assert by_id[3] == [(3, 2)] * 3  # one document and two repeated rows
    assert ngram_join.ngram_jaccard_join(odd_docs.limit(0)).count() == 0


@pytest.mark.parametrize("turned", [False, True])
def test_op1_texts_under_one_id(spark, turned):
    """Each row of an id has the links of its own text, whatever the order of the rows."""
    rng = random.Random(9)
    base, other = words(rng, 100), words(rng, 100)
    near = lambda w, k: " ".join([*w[:k], f"new{k}", *w[k + 1 :]])
    rows = [(1, " ".join(base)), (1, " ".join(other)), (1, "alone here"), (2, near(base, 40)), (2, near(other, 30)), (3, near(base, 50)), (4, near(other, 60)), (4, near(other, 60)), (5, None), (5, "single words")]
    docs = spark.createDataFrame(rows[::-1] if turned else rows, "doc_id long, text string").coalesce(1)
    links = brute(rows)
    named = components_of(links)
    least = {root: min(rows[i][0] for i in named if named[i] == root) for root in named.values()}
    want = sorted((rows[i][0], least[named[i]], len(links[i])) for i in named)
    assert sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs).collect()) == want


@pytest.mark.parametrize("times", [1, 10, 1000])
def test_op1_sends_a_repeated_row_once(spark, times):
    """One near copy beside a text that is repeated under its id: two texts meet, however often it is."""
    text = " ".join(words(random.Random(1), 100))
    near = text.replace(text.split()[50], "new", 1)
    docs = spark.createDataFrame([(1, text)] * times + [(2, near)], "doc_id long, text string")
    sent = ngram_join.bodies_of(spark.createDataFrame([(b"a", 1, times), (b"b", 2, 1)], "node binary, rep long, weight long").join(docs.selectExpr("doc_id as rep", "xxhash64(text) as mark").distinct(), "rep"), docs.selectExpr("doc_id as rep", "xxhash64(text) as mark", "text"))
    assert sent.count() == 2
    found = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert found == {1: (1, times), 2: (1, times)}


def test_trees_reach_the_recall():
    levels = ngram_join.forest(0.8, 0.9995)
    missed = [(1 - 0.8**k) ** t for k, t in levels]
    assert [k for k, _ in levels] == sorted(k for k, _ in levels) and sum(missed) <= 0.0005
    assert all((1 - 0.8**k) ** (t - 1) > 0.0005 / len(levels) for k, t in levels)


def test_nodes_of_longer_prefixes_lie_below():
    rng = random.Random(4)
    sets = ngram_join.shingle_sets([" ".join(words(rng, 40, 3)).encode() for _ in range(200)])
    short, middle, long = ngram_join.signatures(sets, [(1, 4), (2, 6), (3, 6)])
    assert short.shape == (200, 4) and long.shape == (200, 6)
    for t in range(4):
        above = {}
        for i in range(200):
            assert above.setdefault(middle[i, t], short[i, t]) == short[i, t]
            assert above.setdefault((long[i, t],), middle[i, t]) == middle[i, t]


def test_prefixes_are_as_short_as_what_they_match_allows(spark):
    """Few members: the shortest prefix. Crowded ones go on, and only they do."""
    rows = [(f"p{i}".encode(), [1], [10 + i]) for i in range(3)] + [(f"q{i}".encode(), [2], [20 + i // 2]) for i in range(6)] + [(b"alone", [3], [30])]
    found = ngram_join.candidates(spark.createDataFrame(rows, "node binary, level_0 array<bigint>, level_1 array<bigint>"), 2, crowd=4).collect()
    assert {(r["prefix"], bytes(r["node"]), bytes(r["least"])) for r in found} == {(1, f"p{i}".encode(), b"p0") for i in range(3)} | {(20 + i // 2, f"q{i}".encode(), f"q{i - i % 2}".encode()) for i in range(6)}


def test_rows_sent_grow_in_proportion_up_to_a_block(spark):
    """Near copies, all candidates of each other: each text is sent once for each block of its group, so that up to a block it is in proportion, and n / block times beyond."""
    sent = {}
    for n in (500, 1000, 2000):
        met = spark.range(n).selectExpr("7L as prefix", "cast(cast(id as string) as binary) as node", "cast('0' as binary) as least")
        sent[n] = ngram_join.meetings(met, met.selectExpr("node", "100L as size")).count()
    assert sent[1000] <= 2 * sent[500] and sent[2000] <= 2 * sent[1000] and sent[500] == 500
    met = spark.range(1024).selectExpr("7L as prefix", "cast(cast(id as string) as binary) as node", "cast('0' as binary) as least")
    assert ngram_join.meetings(met, met.selectExpr("node", "100L as size"), block=256).count() == 4 * 1024


def test_recall_on_pairs_at_the_threshold():
    """Pairs of a similarity just at 0.8, beside crowds that force longer prefixes."""
    rng = np.random.default_rng(6)
    levels = ngram_join.forest(0.8, 0.9995)
    base = [rng.integers(1, 2**62, 90, dtype=np.uint64) for _ in range(3000)]
    near = [np.unique(np.concatenate([b[10:], rng.integers(1, 2**62, 10, dtype=np.uint64)])) for b in base]
    for x, y in zip(*(ngram_join.signatures([np.unique(s) for s in sets], levels) for sets in (base, near)), strict=True):
        assert (x == y).any(axis=1).mean() >= 0.998


def test_shingles_are_counted_like_tuples():
    rng = random.Random(1)
    texts = [" ".join(words(rng, n, 30)) for n in (0, 1, 4, 5, 6, 300)] + ["\t\n a\x0bb ", "é é é é é é", "a\x1cb c d e f"]
    assert [len(s) for s in ngram_join.shingle_sets([t.encode() for t in texts])] == [len(shingles(t)) for t in texts]


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(50)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    other = ~np.eye(50, dtype=bool)  # a set with itself is never asked for
    assert (ngram_join.overlaps(sets, None) == want)[other].all()
    assert (ngram_join.overlaps(sets[:20], sets[20:]) == np.array(want)[:20, 20:]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (5, 5), (200, 201), (None, 3)]
    got = {r["node"]: r["component"] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 98: 98, 99: 98, 100: 98, 200: 200, 201: 200}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed: int, n: int = 300, width: int = 16) -> list[list[float]]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[: n // 3] = x[0] + 0.08 * rng.normal(size=(n // 3, width))  # a crowded cell
    x[n // 3 : n // 3 + 20] = x[1]
    return (x * rng.uniform(0.1, 10, size=(n, 1))).astype(np.float32).tolist()


@pytest.mark.parametrize("block", [16, 4096])
def test_op5(spark, block):
    rows = list(enumerate(vectors(4)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.embedding_near_dedup(spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, node int").repartition(5), block=block).collect()}
    x = np.array([v for _, v in rows], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    links = {i: {j for j in np.flatnonzero(near[i]).tolist() if j != i} for i in range(len(x))}
    named = components_of(links)
    assert got == {i: (len(links[i]), named[i], named[i] == i) for i in links}


def grouped_vectors(seed: int, n: int = 1500, width: int = 24) -> np.ndarray:
    """Unit vectors in groups that lie apart, as embeddings of topics do."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, width))[rng.integers(0, 30, n)] + 0.15 * rng.normal(size=(n, width))
    return embedding_join.unit(x)


def test_intervals_far_apart_are_skipped_and_none_that_link():
    """The descent keeps every pair of intervals with a link, and skips most pairs where vectors have structure."""
    x = grouped_vectors(2)
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    for left, right in ((x, None), (x[:700], x[700:])):
        i, j = embedding_join.linked_pairs(left, right, axes, 0.95)
        near = np.argwhere(left @ (left if right is None else right).T >= 0.95)
        want = {(a, b) for a, b in near.tolist() if right is not None or a < b}
        assert {(min(a, b), max(a, b)) if right is None else (a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want
    place = embedding_join.placed_on(axes, x)
    order = np.lexsort((place[:, 0], *np.floor(place[:, :6] / 0.3162).T[::-1]))
    tree = embedding_join.boxes_of(place[order])
    i, j = embedding_join.near_leaves(tree, tree, math.sqrt(0.1), same=True)
    assert len(i) < 0.5 * len(tree[0][0]) * (len(tree[0][0]) + 1) / 2
    flat = embedding_join.near_leaves(tree, tree, 9.0)
    assert len(flat[0]) == len(tree[0][0]) ** 2 == len(set(zip(*(x.tolist() for x in flat), strict=True)))
    short = embedding_join.boxes_of(place[:40])
    assert len(embedding_join.near_leaves(tree, short, 9.0)[0]) == 2 * len(tree[0][0])


def test_op5_many_blocks_of_structured_vectors(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "LEAF", 8)
    x = grouped_vectors(5, 600)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_join.embedding_near_dedup(frame).collect()}
    near = x @ x.T >= 0.95
    links = {i: {j for j in np.flatnonzero(near[i]).tolist() if j != i} for i in range(len(x))}
    named = components_of(links)
    assert got == {i: (len(links[i]), named[i]) for i in links}


def test_op5_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (9, [1e38, 1e36])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_join.embedding_near_dedup(frame).collect()), key=repr)
    want = [(i, 0, i, True) for i in (0, 1, 2, 3, 4, 5, 8)] + [(6, 4, 6, True), (7, 4, 6, False), (7, 4, 6, False), (9, 4, 6, False), (None, 4, 6, False)]
    assert got == sorted(want, key=repr)
    assert embedding_join.embedding_near_dedup(frame.limit(0)).count() == 0


def test_op5_range_of_cosine(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>")
    for cosine in (0.0, 1.0, 1.5):
        with pytest.raises(ValueError, match="cosine"):
            embedding_join.embedding_near_dedup(vectors, cosine=cosine)
