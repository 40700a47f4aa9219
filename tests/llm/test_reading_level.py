import duckdb
import numpy as np
import oracle

from lexdrift.llm import reading_level as L


def test_isotonic_is_monotone_and_least_squares():
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    y = (x + rng.normal(size=300) > 0).astype(float)
    knots, values = L.isotonic(x, y)
    assert (np.diff(values) >= 0).all() and (np.diff(knots) >= 0).all()
    fit = np.interp(np.sort(x), knots, values)
    assert abs(fit.mean() - y.mean()) < 1e-9
    assert L.isotonic(np.array([1.0, 2, 3]), np.array([3.0, 1, 2]))[1].tolist() == [2, 2]


def test_held_out_accuracy():
    con = duckdb.connect()
    d = f"{oracle.DATA}/sf0.1"
    rows = con.execute(f"SELECT d.doc_id, text, avg(level) FROM '{d}/documents.parquet' d JOIN '{d}/level_labels.parquet' l ON d.doc_id = l.doc_id GROUP BY ALL ORDER BY 1").fetchall()
    x, y = np.array([L.features(r[1]) for r in rows]), np.array([float(r[2]) for r in rows])
    held = np.arange(len(rows)) % 4 == 0
    m = L.LevelModel().fit(x[~held], y[~held])
    assert (m.levels_of(x[held]) == np.round(y[held])).mean() > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "One two. " * 30_000, 0), (3, "x", 0), (4, "\n\n", 0)], "doc_id bigint, text string, level int")
    labels = spark.createDataFrame([(3, 1), (3, None), (None, 2), (99, 3)], "doc_id bigint, level int")
    m = L.fit_levels(docs, labels)
    assert sorted(r.doc_id for r in L.levels(docs, m).collect()) == [1, 2, 3, 3, 4]
    assert {r.level for r in L.levels(docs, m).collect()} == {2}  # nothing to learn an order from
    assert L.levels(docs.limit(0), m).count() == 0
    assert L.fit_levels(docs.limit(0), labels.limit(0)).cuts == [-np.inf, np.inf]
