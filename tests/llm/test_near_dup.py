import random

import numpy as np
import pytest

from logweir.llm.components import connected_components
from logweir.llm.common import Workspace
from logweir.llm.near_dup import NearDuplicates, shingles, superminhash


def brute(rows, k, percent):
    """doc_id -> (n_shingles, component), all pairs compared; ids are unique."""
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            u = len(sets[a] | sets[b])
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * u:
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def grouped(spark, rows, k=3, percent=85, **kw):
    d = spark.createDataFrame(rows, "doc_id long, text string, node string, rep int, key int")
    return NearDuplicates(k, percent, **kw).groups(d).collect()


def full(rows):
    return [(i, t, "x", 1, 2) for i, t in rows]


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k, percent in ((3, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in NearDuplicates(k, percent).groups(docs).collect()}
        assert got == brute(rows, k, percent)


def test_near_copies_in_one_large_bucket(spark):
    """Chains and stars of edited copies of one text: more members than a block, links near the threshold."""
    rng, base = random.Random(5), [f"w{i}" for i in range(120)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in grouped(spark, full(rows))}
    assert got == brute(rows, 3, 85)


def test_edges(spark):
    long = " ".join(f"q{i}" for i in range(60_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "ONE\x0btwo"), (3, "one two three"), (10, long), (11, long + " tail"), (12, "é É"), (13, "É é")]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in grouped(spark, full(rows))}
    assert got[5] == (0, 5, True) and got[6] == (0, 6, True) and got[7] == (0, 7, True)
    assert got[8] == (1, 8, True) and got[9] == (1, 8, False) and got[3] == (1, 3, True)
    assert got[11] == (got[10][0] + 1, 10, False) and got[12][1] == 12 and got[13][1] == 13


def test_null_ids_repeats_and_empty_tables(spark):
    rows = full([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (1, "other words here now"), (None, None)])
    got = grouped(spark, rows)
    assert len(got) == 6
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id) == [(1, 1, True)] * 3 + [(2, 1, False)]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert grouped(spark, []) == []
    d = spark.createDataFrame(rows, "doc_id long, text string, node string, rep int, key int")
    left = NearDuplicates(3, 85).deduplicate(d)
    assert left.columns == d.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, ""), (-1, "a b c d e"), (1, "a b c d e"), (1, "other words here now")]


def test_superminhash_estimates_similarity():
    a = np.arange(1, 1001, dtype=np.uint64)
    b = np.arange(201, 1201, dtype=np.uint64)
    s = superminhash([shingles(b" ".join(b"%d" % i for i in x), 1) for x in (a, b)], 256)
    assert abs((s[0] == s[1]).mean() - 800 / 1200) < 0.1
    one = superminhash([np.array([7], np.uint64), np.empty(0, np.uint64)], 64)
    assert sorted(np.floor(one[0])) == list(range(64)) and np.isinf(one[1]).all()


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(200)] if seed == 0 else [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    got = {r.node: r.comp for r in connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long"), limit=20).collect()}
    up = {}
    for _ in range(300):
        for a, b in edges:
            m = min(up.get(a, a), up.get(b, b))
            up[a] = up[b] = m
    assert got == {n: c for n, c in up.items() if any(n in e and e[0] != e[1] for e in edges)}


def edited(n, words, most, seed=9, tokens=10**6):
    """Copies of one text, each with up to so many replaced, dropped or added words."""
    rng, base = random.Random(seed), [f"w{i}" for i in range(words)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(most + 1)):
            at, kind = rng.randrange(len(w)), rng.randrange(4)
            if kind < 2:
                w[at] = f"x{rng.randrange(tokens)}"
            elif kind == 2:
                del w[at]
            else:
                w.insert(at, f"y{rng.randrange(tokens)}")
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_recall_against_brute_force(spark, k, percent):
    """Links near the threshold, shared edits, several families: every component is the one of all pairs."""
    rows = edited(260, 90, 9, seed=k) + [(1000 + i, t) for i, t in edited(160, 60, 5, seed=2, tokens=3)]
    rows += [(2000 + i, f"{t} {' '.join(f'z{i % 7}{j}' for j in range(i % 12))}") for i, t in edited(120, 50, 2, seed=4)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in grouped(spark, full(rows), k, percent)}
    assert got == brute(rows, k, percent)


def test_rows_grow_with_the_members_of_a_group(spark, monkeypatch):
    """Twice as many near copies of one text make at most about twice as many rows, in every table that is written."""

    def sizes(n):
        seen = {}
        real = Workspace.stage

        def stage(self, df, name):
            out = real(self, df, name)
            seen[name] = seen.get(name, 0) + out.count()
            return out

        with monkeypatch.context() as m:
            m.setattr(Workspace, "stage", stage)
            grouped(spark, full(edited(n, 120, 8)))
        return seen

    one, two = sizes(1000), sizes(2000)
    assert one["against"] > 1000
    assert all(two[k] <= 2.6 * one[k] + 200 for k in two)


def test_extra_columns_and_long_texts(spark):
    long = " ".join(f"q{i % 977}r{i % 89}" for i in range(30_000))
    rows = [(1, long, "a", 1, 2), (2, long + " end", "b", 3, 4), (2, long + " end", "b", 3, 4), (3, "other text stands here", None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, hub string, v int, comp int")
    left = NearDuplicates(5, 80).deduplicate(d)
    assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]
    assert NearDuplicates(5, 80).deduplicate(d.where("doc_id > 9")).collect() == []
