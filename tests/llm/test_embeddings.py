import numpy as np

from logweir.llm.embed_dup import EmbeddingNeighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node string, comp int"


def brute(rows, threshold=0.93):
    ok = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v) and np.any(v)]
    links = {i: set() for i, _, _ in ok}
    for n, (i, v, y) in enumerate(ok):
        for j, w, z in ok[n + 1 :]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    comp = {i: i for i in links}
    for _ in links:
        new = {i: min([comp[i], *(comp[j] for j in links[i])]) for i in links}
        if new == comp:
            break
        comp = new
    return {i: (len(links[i]), comp[i]) for i in links}


def test_against_brute_force(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    e = EmbeddingNeighbours()
    got = {r.vec_id: (r.n_links, r.component_id) for r in e.links(t).collect()}
    assert got == brute(rows) and e.measured == 1.0


def test_edges(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal(8)
    near = [a + 0.05 * rng.standard_normal(8) for _ in range(40)]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(near)] + [(100 + i, near[0].tolist(), 1) for i in range(30)]
    rows += [(200, near[0].tolist(), 2), (201, near[0].tolist(), None), (202, None, 1), (203, [0.0] * 8, 1), (204, [float("nan")] * 8, 1), (205, [None] * 8, 1), (206, [float("inf")] + [0.0] * 7, 1), (207, [], 1), (208, [1.0, 2.0], 1), (209, (2 * a).tolist(), 1)]
    rows = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, rows[0][1], 1, "x", 1)], SCHEMA)
    got = EmbeddingNeighbours().links(d).collect()
    assert len(got) == len(rows) + 1
    want = brute(rows)
    by = {r.vec_id: r for r in got}
    for i, (n, c) in want.items():
        assert by[i].component_id == c and by[i].n_links == n + (1 if n else 0) and by[i].kept == (c == i)  # the null id is a vector too
    for i in (201, 202, 203, 204, 205, 206, 207):
        assert (by[i].n_links, by[i].component_id, by[i].kept) == (0, i, True)
    assert by[None].component_id is None and by[None].kept
    assert EmbeddingNeighbours().links(spark.createDataFrame([], SCHEMA)).collect() == []


def test_links_that_the_descent_misses(spark):
    t = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rng = np.random.default_rng(5)
    rows = [(r.vec_id, r.embedding, r.label) for r in t.collect()]
    for i in range(60):  # pairs just above the threshold, which few codes bring together
        v, w = rng.standard_normal((2, 64))
        v /= np.sqrt(v @ v)
        w -= (w @ v) * v
        w = 0.935 * v + np.sqrt(1 - 0.935**2) * w / np.sqrt(w @ w)
        rows += [(10_000 + 2 * i, v.tolist(), 1), (10_001 + 2 * i, w.tolist(), 1)]
    e = EmbeddingNeighbours(tables=1, width=4, turns=0)
    got = {r.vec_id: (r.n_links, r.component_id) for r in e.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == brute(rows) and e.measured < 1.0


def test_saturated_lists_grow(spark):
    """A group far larger than a list, two groups in touch, repeated rows and ties at equal distances."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal(16)
    rows = [(i, (a + 0.08 * rng.standard_normal(16)).tolist(), 1) for i in range(150)]
    rows += [(300 + i, (3 * rng.standard_normal(16)).tolist(), 1 + i % 2) for i in range(60)] + [(500 + i, rows[0][1], 1) for i in range(3)] + [rows[5]]
    rows += [(600 + i, [1.0 if j == i else 0.0 for j in range(16)], 2) for i in range(8)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    e = EmbeddingNeighbours(k=4)
    out = e.links(d).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    want = brute([(1000 + i if n == len(rows) - 9 else i, v, y) for n, (i, v, y) in enumerate(rows)])
    again = want.pop(1005)
    assert len(out) == len(rows) and got == want | {5: (again[0], again[1])}
    assert 0.9 <= e.measured <= 1.0
    assert e.audited > 20_000
    none = EmbeddingNeighbours()
    assert none.links(d.where("label = 9")).collect() == [] and none.audited == 0
