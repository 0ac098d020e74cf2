import random

import numpy as np
import pytest

from lodestone.llm import common, jaccard
from lodestone.llm.components import components

from .conftest import DATA, same


def brute(rows):
    """component of every row by comparing all pairs."""
    sets = []
    for doc, text in rows:
        words = [w.decode() for w in (text or "").encode().lower().split()]
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    comp = list(range(len(rows)))
    find = lambda i: i if comp[i] == i else find(comp[i])
    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                comp[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(s), least[find(i)]) for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def test_equals_sql(spark, duck):
    same(jaccard.op6_jaccard_join(spark, DATA), duck.sql(jaccard.SQL))


def test_odd_rows(odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.where("doc_id IS NOT NULL").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jaccard.cluster(odd.where("doc_id IS NOT NULL")).collect()) == brute(rows)
    assert jaccard.cluster(odd).count() == odd.count() and jaccard.cluster(empty).count() == 0


@pytest.mark.parametrize("seed, often", [(1, 3), (2, 1 << 40)])
def test_chains_and_hot_passages(spark, monkeypatch, seed, often):
    """Drifting copies around the threshold, documents that share a long passage but no more, a
    large group of near copies about the threshold from each other, and short documents.  Without
    frequent shingles the shared passages make regions that only further shingles divide."""
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    rows, text = [], list(base)
    for i in range(40):
        text = list(text)
        text[rng.randrange(80)] = f"v{i}"
        rows.append((i, " ".join(text if i % 2 else base[: 70 + i % 9] + [f"z{i}"])))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(100 + i, passage + " " + " ".join(f"own{i}x{k}" for k in range(rng.choice((5, 10, 40))))) for i in range(40)]
    group = [f"g{rng.randrange(900)}" for _ in range(120)]
    for i in range(150):
        words = [w if rng.random() > rng.choice((0.005, 0.02, 0.04)) else f"r{i}" for w in group]
        rows.append((200 + i, " ".join(words)))
    rows += [(400 + i, "six words that they all share " + " ".join(f"far{i}x{k}" for k in range(12 + i % 3))) for i in range(60)]
    rows += [(500 + i, " ".join(f"s{k}" for k in range(i % 12))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.cluster(df).collect()) == brute(rows)


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(300_000))
    rows = [(1, text), (2, text + " end"), (3, text[: len(text) // 2])]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1] == (299_996, 1) and found[2] == (299_997, 1) and found[3][1] == 3


def test_bound_never_drops_a_link(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(30):
        members = np.unique(rng.integers(0, 1 << 60, 60).astype(np.uint64))
        own, other = members[: 50 + k % 8], members[k % 6 :]
        both = len(np.intersect1d(own, other))
        firsts = [jaccard.first_shingles(x, (np.zeros(0, np.uint64),) * 2, 75) for x in (own, other)]
        common = len(np.intersect1d(*firsts))
        most = min(len(own), len(other), common + max(len(own) - len(firsts[0]), len(other) - len(firsts[1])))
        assert both <= most
        rows.append(both)
    assert rows


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    assert {(r["node"], r["comp"]) for r in components(edges).collect()} == {(i, 0) for i in range(51)} | {(100, 100), (101, 100)}


def test_a_large_group_of_unlinked_near_copies_makes_few_rows(spark, monkeypatch):
    """300 texts of one base that link with few or none of the others: components as by comparing
    all, and rows in proportion to the texts, not to their square."""
    rng = random.Random(4)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(5, 95), 4 if i % 10 else 2):
            words[k] = f"own{i}x{k}"
        rows.append((i, " ".join(words)))
    made, real = [], common.cut

    def counted(df, name):
        out = real(df, name)
        if name in ("met", "possible"):
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "cut", counted)
    monkeypatch.setattr(jaccard, "BLOCK", 100)  # so that a region has several blocks
    found = sorted(map(tuple, jaccard.cluster(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert found == brute(rows) and 1 < len({r[2] for r in found}) < 300
    assert sum(made) < 40 * len(rows), made


def test_common_counts_are_exact():
    rng = np.random.default_rng(3)
    for n, m, kinds in ((1, 1, 5), (40, 30, 60), (60, 70, 100_000)):
        own, other = ([np.unique(rng.integers(0, kinds, 200)).astype(np.uint64) for _ in range(k)] for k in (n, m))
        assert jaccard.in_common(own, other).tolist() == [[len(np.intersect1d(x, y)) for y in other] for x in own]
    assert jaccard.in_common([np.array([1], np.uint64)], [np.array([2], np.uint64)]).tolist() == [[0]]


def test_only_nodes_near_a_pivot_are_joined_to_their_distances(spark, monkeypatch):
    """A region of three pivots: the division is that by all distances, and of the pairs met only
    those nearer than a node can leave a pivot by make rows."""
    rng = random.Random(6)
    nodes, pivots = range(100, 160), (1, 2, 3)
    sizes = {(p, y): (rng.randrange(60, 70) if y < 108 and p == y % 3 + 1 else rng.randrange(5, 45), 100) for p in pivots for y in nodes if rng.random() < 0.9}
    rows = lambda data, schema: spark.createDataFrame(list(data), schema)
    regions = rows([(7, [1], y) for y in nodes], "region long, codes array<int>, node long")
    known = rows([(*k, *v) for k, v in sizes.items()], "a long, b long, common long, union long")
    met = rows([(7, y, p, p, y) for p in pivots for y in nodes], "region long, node long, pivot long, a long, b long")
    made, real = {}, common.cut

    def counted(df, name):
        out = real(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(common, "cut", counted)
    found = jaccard.divided(regions, rows([(7, p) for p in pivots], "region long, pivot long"), met, known, 0.25).collect()
    assert made["nearest"] <= 8 and 0 < made["beyond"] <= 16, made
    away = lambda p, y: 1 - sizes[p, y][0] / 100
    stays = lambda p, y: (p, y) not in sizes or away(p, y) <= min(away(q, y) for q in pivots if (q, y) in sizes) + 0.5 + 1e-9
    parts = {frozenset(y for y in nodes if stays(p, y)) for p in pivots}
    whole = {frozenset(nodes)}
    got = {}
    for r in found:
        got.setdefault(r["region"], set()).add(r["node"])
    assert {frozenset(g) for g in got.values()} == (parts if sum(len(p) ** 2 for p in parts) < len(nodes) ** 2 else whole)
