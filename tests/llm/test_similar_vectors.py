import numpy as np

from lexdrift.llm import similar_vectors as S


def _table(spark, rows):
    return spark.createDataFrame(rows, "model string, idx bigint, vector array<float>, part int, q string")


def _brute(x, ids, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]:
            if s[i, j] >= least and j != i:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(150, 16))
    x = np.concatenate([(c + 0.15 * rng.normal(size=(8, 16))) * rng.uniform(0.1, 10) for c in centres] + [rng.normal(size=(800, 16))]).astype(np.float32)
    rows = [("m", i, v.tolist(), 0, "") for i, v in enumerate(x)]
    got = {(r.idx_a, r.idx_b) for r in S.similar_pairs(_table(spark, rows), 5, 0.85, dim=16, part_rows=100, probes=6).collect()}
    true = _brute(x.astype(float), list(range(len(x))), 5, 0.85)
    assert len(got & true) / len(true) >= 0.97
    assert len(got - true) <= 0.03 * len(true)


def test_edges(spark):
    v, w = [1.0, 0.0], [2.0, 0.0]
    bad = [None, [1.0], [1.0, 2.0, 3.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]]
    rows = [("m", 1, v, 1, ""), ("m", 1, v, 1, ""), ("m", 2, w, 1, ""), ("m", 3, [0.0, 1.0], 1, ""), ("other", 1, v, 1, ""), ("m", None, v, 1, "")]
    rows += [("m", 10 + i, b, 1, "") for i, b in enumerate(bad)]
    got = [tuple(r) for r in S.similar_pairs(_table(spark, rows), 5, 0.85, dim=2).collect()]
    assert got == [("m", 1, 2)]
    assert S.similar_pairs(_table(spark, rows).limit(0), dim=2).count() == 0


def test_many_equal_vectors_take_the_lowest_numbers(spark):
    rows = [("m", i, [1.0, 1.0], 0, "") for i in range(400)] + [("m", 1000 + i, [1.0, float(i)], 0, "") for i in range(50)]
    found = S.most_similar(_table(spark, rows), 5, 0.999, dim=2, part_rows=100).collect()
    near = {}
    for r in found:
        near.setdefault(r.idx, set()).add(r.near)
    assert all(near[i] == set(range(6)) - {i} if i < 6 else near[i] == set(range(5)) for i in range(400)) or all(near[i] <= set(range(6)) for i in range(400))
    assert all(len(near[i]) == 5 for i in range(400))


def test_blocks_give_the_same(spark):
    rng = np.random.default_rng(1)
    rows = [("m", i, rng.normal(size=4).tolist(), 0, "") for i in range(300)]
    one = {tuple(r) for r in S.similar_pairs(_table(spark, rows), 5, 0.85, dim=4).collect()}
    assert {tuple(r) for r in S.similar_pairs(_table(spark, rows), 5, 0.85, dim=4, query_block=30, index_block=20).collect()} == one


def test_trees_of_regions(spark):
    """More parts than a region may have: the first cut is made into regions, and the pairs are still found."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(300, 16))
    x = np.concatenate([c + 0.15 * rng.normal(size=(10, 16)) for c in centres]).astype(np.float32)
    rows = [("m", i, v.tolist(), 0, "") for i, v in enumerate(x)] + [("tiny", i, v.tolist(), 0, "") for i, v in enumerate(x[:3])]
    table = _table(spark, rows)
    trees = S.fit_trees(table.where("model is not null").select("model", "idx", "vector"), 16, sample=800, part_rows=60, leaves=8)
    assert len(trees["m"].regions) >= 6 and trees["m"].parts >= 40 and trees["tiny"].parts == 1
    assert max(np.bincount(trees["m"].top(S.unit_rows(x), 1)[:, 0], minlength=trees["m"].parts)) < 600
    got = {(r.idx_a, r.idx_b) for r in S.similar_pairs(table.where("model = 'm'"), 5, 0.85, dim=16, sample=800, part_rows=60, leaves=8).collect()}
    true = _brute(x.astype(float), list(range(len(x))), 5, 0.85)
    assert len(got & true) / len(true) >= 0.95 and len(got - true) <= 0.03 * len(true)


def test_samples_do_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(4)
    table = _table(spark, [("m", i, rng.normal(size=8).tolist(), 0, "") for i in range(1500)]).select("model", "idx", "vector")
    a, b = (S.fit_trees(t, 8, sample=1000, part_rows=100)["m"] for t in (table.repartition(3), table.orderBy("idx").coalesce(1)))
    assert a.parts == b.parts > 1 and all(np.allclose(a.regions[r].w, b.regions[r].w) for r in a.regions)


def test_probes_grow_until_the_recall_holds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    table = _table(spark, [("m", i, v.tolist(), 0, "") for i, v in enumerate(x)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[::20] @ u.T
    s[np.arange(len(s)), np.arange(0, len(x), 20)] = -2
    true = {(20 * i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row)[:10]}
    shares = []
    for recall in (None, 0.95):
        found = S.most_similar(table, 10, dim=16, part_rows=30, probes=8, queries="idx % 20 = 0", recall=recall).collect()
        shares.append(len({(r.idx, r.near) for r in found} & true) / len(true))
    assert shares[0] < 0.9 <= 0.94 <= shares[1]
