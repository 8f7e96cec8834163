import numpy as np
import pytest

from parcelscope.llm import graphs, hnsw, nn_descent, queries


def cloud(seed, groups, spread=0.02, noise=600, dim=24):
    """Vectors of two labels: noise, and groups of near copies of the given sizes."""
    draw = np.random.default_rng(seed)
    rows = [draw.normal(size=(noise, dim))]
    for size in groups:
        rows.append(draw.normal(size=dim) + draw.normal(size=(size, dim)) * spread * draw.uniform(0.2, 4))
    values = np.concatenate(rows).astype(np.float32)
    return values[draw.permutation(len(values))], draw.integers(0, 2, len(values))


def plain_links(values, labels, least=0.93):
    unit = values.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    a, b = np.nonzero(near)
    return near.sum(axis=1), graphs.components_of(len(values), a, b)


def test_beam_search_is_exhaustive_at_full_width():
    draw = np.random.default_rng(0)
    vectors = draw.normal(size=(300, 8)).astype(np.float32)
    graph = hnsw.Graph(vectors)
    ids, scores = graph.search(vectors[:20], 300)
    want = np.argsort(-(vectors[:20] @ vectors.T), axis=1)[:, :50]
    assert (ids[:, :50] == want).mean() > 0.99 and (np.diff(scores, axis=1) <= 0).all()


def test_small_world_recall():
    draw = np.random.default_rng(1)
    vectors = hnsw.unit(draw.normal(size=(3000, 32))).astype(np.float32)
    graph = hnsw.Graph(vectors)
    found = graph.search(vectors[:200], 64)[0]
    truth = list(np.argsort(-(vectors[:200] @ vectors.T), axis=1)[:, :10])
    assert graphs.reached(found, truth) > 0.95


@pytest.mark.parametrize("rows,tile", [(20_000, 1024), (150, 32)])
def test_links_against_brute_force(spark, monkeypatch, rows, tile):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", rows)
    monkeypatch.setattr(hnsw, "TILE", tile)
    values, labels = cloud(3, [300, 40, 5, 2, 2, 3, 2])
    frame = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(values, labels))],
                                  "vec_id long, embedding array<float>, label int")
    links, component = plain_links(values, labels)
    got = {r.key: r for r in hnsw.linked(frame).collect()}
    assert len(got) == len(values)
    right = sum(got[i].n_links == links[i] and got[i].component == component[i] for i in got)
    assert right >= 0.99 * len(values)
    assert all(r.kept == (r.key == r.component) and r.n_links <= links[r.key] for r in got.values())


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1),
            (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (None, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1),
            (12, [1e-30, 0.0], 1), (12, [1e-30, 0.0], 1), (13, [-1.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, component string")
    out = hnsw.linked(frame).collect()
    assert len(out) == len(rows)
    got = {r.key: (r.n_links, r.component, r.kept) for r in out}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[12] == (2, 1, False)
    for key in (3, 4, 5, 6, 7, 8, 9, 10, 11, 13):
        assert got[key] == (0, key, True)
    assert got[None] == (0, None, True)
    assert hnsw.linked(frame.limit(0)).count() == 0


def test_link_query_on_whole_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    links, component = plain_links(np.array([r.embedding for r in rows]), np.array([r.label for r in rows]))
    got = {r.vec_id: r for r in queries.op3_near_vectors(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, r in enumerate(rows):
        assert (got[r.vec_id].n_links, got[r.vec_id].component_id) == (links[i], rows[component[i]].vec_id)


def plain_nearest(ids, values, asked, count):
    products = values.astype(np.float64) @ values.astype(np.float64).T
    out = {}
    for i in asked:
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-products[i, j], ids[j]))[:count]
        out[ids[i]] = [(ids[j], products[i, j]) for j in order]
    return out


@pytest.mark.parametrize("rows", [32_768, 250])
def test_nearest_against_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(nn_descent, "SHARD_ROWS", rows)
    draw = np.random.default_rng(5)
    values = (draw.normal(size=(900, 16)) * draw.uniform(0.2, 3, size=(900, 1))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), i) for i, v in enumerate(values)], "vec_id long, embedding array<float>, score int")
    asked = list(range(0, 900, 20))
    want = plain_nearest(list(range(900)), values, asked, 20)
    got = {}
    for r in nn_descent.nearest(frame, frame.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append(r)
    assert got.keys() == want.keys()
    hits = 0
    for key, found in got.items():
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and key not in [r.vec_id for r in found]
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(found, found[1:]))
        for r in found:
            assert np.isclose(r.score, values[key].astype(float) @ values[r.vec_id].astype(float), rtol=1e-12)
        hits += len({r.vec_id for r in found} & {v for v, _ in want[key]})
    assert hits / (20 * len(want)) >= 0.95


def test_nearest_edge_cases(spark):
    rows = [(0, [1.0, 0.0], "c"), (1, [0.5, 0.0], "c"), (2, [0.5, 0.0], "c"), (2, [0.5, 0.0], "c"), (3, None, "c"), (4, [0.0, 0.0], "c"),
            (5, [float("nan"), 1.0], "c"), (None, [9.0, 9.0], "c"), (6, [1.0, 2.0, 3.0], "c"), (7, [-1.0, 0.0], "c"), (20, [2.0, 1.0], "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = [tuple(r) for r in nn_descent.nearest(frame, frame.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (0, 4, 7, -1.0),
                   (20, 1, 0, 2.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 7, -2.0)]
    assert nn_descent.nearest(frame.limit(0), frame).count() == 0
    assert nn_descent.nearest(frame, frame.limit(0)).count() == 0


def test_nearest_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    values = np.array([r.embedding for r in rows], np.float32)
    want = plain_nearest([r.vec_id for r in rows], values, [i for i, r in enumerate(rows) if r.vec_id % 20 == 0], 20)
    got = {}
    for r in queries.op9_nearest(spark, folder).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got.keys() == want.keys()
    assert sum(len(got[k] & {v for v, _ in want[k]}) for k in want) >= 0.9 * 20 * len(want)


def towards(draw, v, cosine, size, jitter):
    """Unit vectors at about `cosine` to v, and each other's near copies."""
    w = draw.normal(size=len(v))
    w -= (w @ v) * v
    w = cosine * v + np.sqrt(1 - cosine ** 2) * w / np.linalg.norm(w)
    return hnsw.unit(w + draw.normal(size=(size, len(v))) * jitter)


@pytest.mark.parametrize("rows,jitter", [(20_000, 0.0), (1000, 0.0), (20_000, 1e-4), (1000, 1e-4)])
def test_links_between_groups_of_copies(spark, monkeypatch, rows, jitter):
    monkeypatch.setattr(hnsw, "SHARD_ROWS", rows)
    draw = np.random.default_rng(8)
    v = hnsw.unit(draw.normal(size=(1, 24)))[0]
    values = np.concatenate((towards(draw, v, 1.0, 200, jitter), towards(draw, v, 0.95, 200, jitter),
                             draw.normal(size=(1600, 24)))).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(values)], "vec_id long, embedding array<float>, label int")
    got = {r.key: (r.n_links, r.component, r.kept) for r in hnsw.linked(frame).collect()}
    links, component = plain_links(values, np.ones(len(values), int))
    assert (links[:400] == 399).all()
    assert got == {i: (links[i], component[i], component[i] == i) for i in range(len(values))}


def test_audit_sees_a_graph_that_is_not_searchable():
    draw = np.random.default_rng(9)
    exact = hnsw.unit(draw.normal(size=(2000, 24)))
    asked = hnsw.unit(np.concatenate((draw.normal(size=(1500, 24)), exact[[1234]] + 1e-3)))
    graph = hnsw.Graph(exact.astype(np.float32))
    graph.layers[-1][:] = -1
    query, node = hnsw.near_pairs(graph, exact, asked, 0.93)
    assert (query.tolist(), node.tolist()) == ([1500], [1234])


@pytest.mark.parametrize("rows", [32_768, 400])
def test_nearest_among_ties(spark, monkeypatch, rows):
    monkeypatch.setattr(nn_descent, "SHARD_ROWS", rows)
    draw = np.random.default_rng(6)
    values = draw.normal(size=(1500, 16))
    values[:, 0] = 0
    hot = draw.permutation(1500)[:450]
    values[hot] = 3 * values[0]                                       # copies
    values[hot[150:300], 0] = draw.normal(size=150)                   # ties for the queries, which have no such component
    values[hot[300:]] *= 1 + 1e-9 * draw.permutation(150)[:, None]    # alike in single precision
    asked = [i for i in range(0, 1500, 20) if values[i, 0] == 0]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<double>")
    whole = [np.einsum("d,id->i", values[i], values) for i in asked]
    got = {}
    for r in nn_descent.nearest(frame, frame.where(frame.vec_id.isin(asked))).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    near = 0
    for i, products in zip(asked, whole):
        want = sorted((j for j in range(1500) if j != i), key=lambda j: (-products[j], j))[:20]
        if set(want) <= set(hot.tolist()):
            near += 1
            assert got[i] == want
    assert near > 10


def test_link_search_grows_with_the_rows(monkeypatch):
    """Among unstructured vectors with few links, a larger graph is searched with the same beam and loses no link."""
    work, cuts = [], []
    search, cut = hnsw.Graph.search, hnsw.Graph._diverse
    monkeypatch.setattr(hnsw.Graph, "search", lambda g, q, width, own=None: work.append(len(q) * width) or search(g, q, width, own))
    monkeypatch.setattr(hnsw.Graph, "_diverse", lambda g, ids, *rest: cuts.append(len(ids)) or cut(g, ids, *rest))
    for n in (1000, 5000):
        draw = np.random.default_rng(11)
        exact = hnsw.unit(draw.normal(size=(n, 64)))
        for i in range(60):
            exact[n // 2 + i] = towards(draw, exact[i], 0.931, 1, 0)[0]
        work.clear(), cuts.clear()
        graph = hnsw.Graph(exact.astype(np.float32))
        query, node = hnsw.near_pairs(graph, exact, exact, 0.93, np.arange(n))
        assert {(i, n // 2 + i) for i in range(60)} <= set(zip(query.tolist(), node.tolist()))
        assert max(work) == 32 * n and sum(cuts) <= 12 * n


def test_audit_of_links():
    draw = np.random.default_rng(12)
    exact = hnsw.unit(draw.normal(size=(500, 24)))
    probes = hnsw.planted(exact, np.arange(0, 500, 2), 0.93)
    assert np.allclose(np.einsum("id,id->i", probes, exact[::2]), 0.9301) and np.allclose((probes ** 2).sum(axis=1), 1)
    assert np.allclose(hnsw.planted(exact, np.array([3]), 0.93) @ exact[3], 0.9301)      # no other node to turn to
    assert hnsw._recall(np.array([[3, 4], [-1, -1]]), [np.arange(50), np.arange(50)], 2) == 0.5
    assert hnsw._recall(np.array([[3, 4]]), [np.empty(0, int)], 2) == 1
