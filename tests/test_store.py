"""Stores, views, updates, names, preconditions, the log, files."""

from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from conftest import X, golden_frames

from annmatrix.functions import predicate
from annmatrix.functions.names import NameRegistry, PipelineStateValidator, StateError
from annmatrix.operators import analysis, research
from annmatrix.sources.dataset import from_frames
from annmatrix.sources.matrix import Matrix, from_array, read_matrix_market, write_matrix_market
from annmatrix.sources.store import Store, plain_json


@pytest.fixture
def store(spark, tmp_path):
    obs, var = golden_frames()
    graph = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "row long, col int, value double")
    with Store.from_frames(spark, str(tmp_path / "s"), obs, var, X, layers={"counts": 3 * X}, obsm={"X_pca": X[:, :2].astype(float)}, obsp={"connectivities": Matrix(graph, "coo", 7, 7)}, uns={"a": {"b": np.int64(3)}}) as made:
        yield made


def test_round_trip_and_reopen(spark, store):
    again = Store.open(spark, store.path)
    assert again.shape == (7, 4) and again.obs_names == [f"cell_{i}" for i in range(7)] and again.var_names == ["f0", "f1", "f2", "f3"]
    assert again.obs.schema["kind"].metadata["categories"] == ["T", "B", "unused"]
    assert again.uns == {"a": {"b": 3}} and again.keys("layers") == ["counts"]
    got = np.array([r.values for r in again.X.rows.orderBy("row").collect()])
    np.testing.assert_array_equal(got, X)
    assert again.get_state()["obsp_keys"] == ["connectivities"]


def test_create_and_open_errors(spark, tmp_path, store):
    with pytest.raises(FileNotFoundError):
        Store.open(spark, str(tmp_path / "none"))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="not a store"):
        Store.open(spark, str(tmp_path / "empty"))
    with pytest.raises(FileExistsError):
        Store.create(spark, store.path)
    (tmp_path / "file").write_text("x")
    with pytest.raises(ValueError, match="not a folder"):
        Store.create(spark, str(tmp_path / "file"))
    assert Store.create(spark, store.path, overwrite=True).n_obs == 0


def test_alignment(spark, store):
    with pytest.raises(ValueError, match="X has 3 rows but obs has 7 rows"):
        store.write_matrix("X", X[:3])
    with pytest.raises(ValueError, match="rows"):
        store.write_obs(golden_frames()[0].iloc[:2])
    with pytest.raises(ValueError):
        store.write_matrix("layers/a", X[:, :2])
    with pytest.raises(ValueError):
        from_frames(spark, golden_frames()[0], golden_frames()[1], X[:3])
    for key in ("", ".", "a/b"):
        with pytest.raises(ValueError):
            store.write_matrix(f"layers/{key}" if "/" not in key else "layers/../x", X)
    with pytest.raises(ValueError, match="canonical"):
        store.put_obsm("my_result", X)


def test_updates(store):
    view = store.query_obs('"site" = ?', ["north"])
    store.update_obs("site", ["cell_0", "cell_2"], ["zz", "zz"])
    assert store.query_obs("site = 'zz'").obs_names == ["cell_0", "cell_2"]
    assert view.obs_names == ["cell_0", "cell_2", "cell_4", "cell_6"]  # a snapshot
    assert store.update_obs_where("site", "q", 'site = ? OR site = ?', ["zz", "north"]) == 4
    assert store.update_obs_where("site", "q", "site = 'none'") == 0
    store.add_obs_column("score", [1.5] * 7)
    store.add_obs_column("flavour", pd.Series(pd.Categorical(["a", "b"] * 3 + ["a"])))
    assert dict(store.obs.dtypes)["score"] == "double"
    assert store.obs.schema["flavour"].metadata["categories"] == ["a", "b"]
    store.update_obs("flavour", pd.Series({"cell_3": "T"}))
    assert not store.obs.schema["flavour"].metadata
    ops = [e["operation"] for e in store.provenance.read_log()]
    assert ops == ["import", "update_obs", "update_obs_where", "add_obs_column", "add_obs_column", "update_obs"]
    assert store.provenance.query(key="site", operation="update_obs")[0]["old_hash"] != store.provenance.query(key="site")[0]["new_hash"]
    with pytest.raises(ValueError):
        store.update_obs("site", ["cell_0", "cell_0"], ["a", "b"])
    with pytest.raises(KeyError):
        store.update_obs("site", ["ghost"], ["a"])
    with pytest.raises(KeyError):
        store.update_obs("nope", ["cell_0"], ["a"])
    with pytest.raises(ValueError):
        store.add_obs_column("score", [1] * 7)
    with pytest.raises(ValueError):
        store.add_obs_column("other", [1] * 3)
    store.update_obs("site", [], [])
    assert store.vacuum() > 0


def test_views(spark, store, tmp_path):
    assert {(r.row, r.col) for r in store.query_obs("_pos in (2, 3, 5, 6)").obsp["connectivities"].entries().collect()} == {(2, 3), (5, 6)}
    view = store.query_obs('"site" = ?', ["south"], ["site"])
    fine = view.refine('"kind" = ?', ["B"], ["kind"])
    assert fine.obs_names == ["cell_1"] and fine.obs_columns == ["kind"]
    assert fine.where == '("site" = ?) AND ("kind" = ?)' and fine.params == ("south", "B")
    pairs = {(r.row, r.col) for r in view.obsp["connectivities"].entries().collect()}
    assert pairs == set()
    view.save("south")
    assert store.named_views == ["south"] and store.load_view("south").obs_names == view.obs_names
    assert store.load_view("south").columns == ["site"]
    with pytest.raises(KeyError):
        store.load_view("nope")
    copy = view.materialize(str(tmp_path / "copy"))
    assert copy.shape == (3, 4) and copy.obs_names == view.obs_names
    np.testing.assert_array_equal([r["values"] for r in copy.X.rows.orderBy("row").collect()], X[[1, 3, 5]])
    assert {(r.row, r.col) for r in copy.obsp["connectivities"].entries().collect()} == set()
    view.put_obsm("X_umap", from_array(spark, np.zeros((3, 2))))
    assert "X_umap" in view.obsm and "X_umap" not in store.obsm
    with pytest.raises(ValueError):
        view.put_obsm("odd", from_array(spark, np.zeros((3, 2))))
    values = view.obs.selectExpr("_id", "'new' as value")
    with pytest.raises(KeyError):
        view.update_obs("fresh", values)
    view.update_obs("fresh", values, create=True, fill_value="old")
    assert [r.fresh for r in store.obs.orderBy("_pos").collect()] == ["old", "new", "old", "new", "old", "new", "old"]
    with pytest.raises(ValueError):
        store.materialize_many({"x": copy.query_obs()})
    got = store.materialize_many({"a": store.query_obs("site = 'north'"), "b": store.query_obs("TRUE")}, features=["f3", "f0"])
    assert {(r.name, r.row, r.col, r.value) for r in got.where("name = 'a' and value <> 0").collect()} == {("a", o, j, X[i, f]) for o, i in enumerate((0, 2, 4, 6)) for j, f in ((0, 3), (1, 0)) if X[i, f]}


def test_projection_and_partition_errors(store):
    for columns, error in (("site", TypeError), (["site", "site"], ValueError), (["nope"], KeyError)):
        with pytest.raises(error):
            store.query_obs(columns=columns)
    assert store.query_obs(columns=[]).obs_columns == []
    parts = store.partition_obs("site", {"a": "north", "b": np.array(["south"])}, require_complete=True, persist=True)
    assert [v.n_obs for v in parts.values()] == [4, 3] and store.named_views == ["a", "b"]
    with pytest.raises(ValueError):
        store.partition_obs("site", {"a": ["north"], "b": ["north"]})
    with pytest.raises(ValueError, match="no group"):
        store.partition_obs("site", {"only": ["north"]}, require_complete=True, persist=True)
    assert "only" in store.named_views


def test_bundles_and_batches(store):
    got = store.bundle(["X", "layers"], layer_keys=["counts"])
    assert set(got) == {"X", "layers"} and set(got["layers"]) == {"counts"}
    for bad in (lambda: store.bundle(["nope"]), lambda: store.bundle(["obsm"], obsm_keys=["nope"])):
        with pytest.raises((ValueError, KeyError)):
            bad()
    parts = list(store.iter_batches(3, layer="counts"))
    assert [len(o) for o, _ in parts] == [3, 3, 1]
    np.testing.assert_array_equal(np.vstack([v for _, v in parts]), 3 * X)
    with pytest.raises(ValueError):
        store.iter_batches(0)
    with pytest.raises(KeyError):
        store.iter_batches(layer="none")


def test_predicates(spark):
    rows = spark.createDataFrame([(1, "a'b", datetime.date(2020, 1, 1)), (2, 'q"?', None)], "n int, s string, d date")
    at = lambda w, p=(): [r.n for r in predicate.matching(rows, w, p).orderBy("n").collect()]
    assert at('"s" = ?', ["a'b"]) == [1]
    assert at('"s" = ?', ["x' OR 'a' = 'a"]) == []
    assert at("s = 'q\"?' AND n // 2 = 1") == [2]
    assert at("CAST(n AS VARCHAR) = ? AND starts_with(s, 'q')", [np.str_("2")]) == [2]
    assert at("d = ?", [datetime.date(2020, 1, 1)]) == [1]
    assert at("n IN (?, ?)", [np.int64(1), 2]) == [1, 2]
    assert at("s = 'a''b'") == [1]
    for w, p, error in ((" ", (), ValueError), ("n; 1", (), ValueError), ("n = ?", "1", TypeError), ("n = ?", (), ValueError), ("TRUE", (1,), ValueError)):
        with pytest.raises(error):
            predicate.to_spark(w, p)


def test_names_and_preconditions():
    assert NameRegistry.get("PCA", "Harmony") == "X_pca_harmony" and NameRegistry.lookup("X_umap") == ("umap", None)
    assert len(NameRegistry.list_all()) >= 25 and NameRegistry.is_canonical("leiden_harmony")
    with pytest.raises(KeyError):
        NameRegistry.get("pca", "nope")
    check = PipelineStateValidator.validate
    check("unknown", {})
    check("neighbors", {"obsm_keys": ["X_pca_scvi"]})
    check("rank_genes_groups", {"obs_columns": []}, groupby="leiden_2")
    with pytest.raises(StateError) as e:
        check("umap", {"obsp_keys": ["other"]})
    assert e.value.operation == "umap" and e.value.available == ["other"]
    assert len(PipelineStateValidator.list_operations()) == 8


def test_matrix_market_and_subset(spark, tmp_path):
    m = from_array(spark, X, sparse=True)
    write_matrix_market(m, str(tmp_path / "m"))
    (tmp_path / "one").write_text("%%MatrixMarket matrix coordinate integer general\n% note\n2 3 2\n1 1 5\n2 3 7\n")
    one = read_matrix_market(spark, str(tmp_path / "one"), transpose=True)
    assert one.shape == (3, 2) and {tuple(r) for r in one.entries().collect()} == {(0, 0, 5), (2, 1, 7)}
    order = spark.createDataFrame([(0, 6), (1, 0), (2, 6)], "ord long, row long")
    assert {tuple(r) for r in m.subset(order, [3, 0]).collect()} == {(o, j, X[i, f]) for o, i in ((0, 6), (1, 0), (2, 6)) for j, f in ((0, 3), (1, 0)) if X[i, f]}
    back = read_matrix_market(spark, str(tmp_path / "m"))
    assert back.shape == X.shape and {tuple(r) for r in back.entries().collect()} == {(i, j, X[i, j]) for i, j in zip(*np.nonzero(X), strict=True)}
    with pytest.raises(ValueError):
        from_array(spark, np.zeros(3))


def test_plain_json_and_lost_keys(spark, tmp_path):
    assert plain_json({"a": np.array([1, 2]), "b": pd.Categorical(["x"]), "c": pd.DataFrame({"d": [1]})}) == {"a": [1, 2], "b": ["x"], "c": {"d": [1]}}
    obs, var = golden_frames()
    with pytest.warns(UserWarning, match="odd"):
        made = Store.from_frames(spark, str(tmp_path / "s"), obs, var, X, uns={"odd": object(), "fine": 1})
    assert made.uns == {"fine": 1}


def test_analysis(spark, tmp_path):
    rng = np.random.default_rng(0)
    points = np.vstack([rng.normal(c, 0.3, (20, 6)) for c in (0, 5, 10)])
    obs = pd.DataFrame({"k": list("abc" * 20)}, index=[f"r{i}" for i in range(60)])
    with Store.from_frames(spark, str(tmp_path / "s"), obs, pd.DataFrame(index=[f"g{i}" for i in range(6)]), points) as store:
        with pytest.raises(StateError):
            analysis.neighbors(store)
        assert analysis.pca(store, 3) == "X_pca"
        centred = points - points.mean(0)
        u, s, _ = np.linalg.svd(centred, full_matrices=False)
        got = np.array([r["values"] for r in store.obsm["X_pca"].rows.orderBy("row").collect()])
        np.testing.assert_allclose(np.abs(got), np.abs((u * s)[:, :3]), atol=1e-8)
        np.testing.assert_allclose(store.uns["X_pca_variance_ratio"], (s**2 / (s**2).sum())[:3], atol=1e-8)
        assert analysis.neighbors(store, 6) == "neighbors"
        near = store.obsp["distances"].entries().toPandas()
        far = np.linalg.norm(got[:, None] - got[None], axis=2)
        np.fill_diagonal(far, np.inf)
        assert near.groupby("row").size().tolist() == [5] * 60
        np.testing.assert_allclose(near.groupby("row")["value"].max().to_numpy(), np.sort(far, 1)[:, 4], atol=1e-6)
        weights = store.obsp["connectivities"].entries().toPandas()
        both = {(r.row, r.col): r.value for r in weights.itertuples()}
        assert all(abs(both[b, a] - v) < 1e-9 for (a, b), v in both.items()) and weights["value"].between(0, 1 + 1e-9).all()
        assert analysis.leiden(store, 0.1) == "leiden"
        labels = [r.leiden for r in store.obs.orderBy("_pos").collect()]
        assert all(len({*labels[i : i + 20]}) == 1 for i in (0, 20, 40)) and len(set(labels)) == 3
        assert analysis.umap(store, epochs=20) == "X_umap" and store.obsm["X_umap"].n_cols == 2
        view = store.query_obs("k = 'a'")
        shares = analysis.variance_shares(store.X.entries(), store.obs.selectExpr("_pos as row", "k as group"), 6).where("group = 'a'").orderBy("rank").toPandas()
        mine = points[::3] - points[::3].mean(0)
        s = np.linalg.svd(mine, compute_uv=False) ** 2
        np.testing.assert_allclose(shares["share"], (s / s.sum())[:5], atol=1e-8)
        assert view.n_obs == 20
        assert [e["operation"] for e in store.provenance.read_log()][-1] == "umap"


def test_communities_in_tables(spark, monkeypatch):
    pairs = [(i, j) for g in (0, 6) for i in range(g, g + 6) for j in range(g, g + 6) if i != j] + [(0, 6), (6, 0)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, w double")
    nodes = spark.range(13).withColumnRenamed("id", "node")
    for bound in (10, 1000):
        monkeypatch.setattr(analysis, "DRIVER_EDGES", bound)
        found = {r.node: r.c for r in analysis.communities(edges, nodes, rounds=4).collect()}
        assert len({found[i] for i in range(6)}) == 1 and len({found[i] for i in range(6, 12)}) == 1 and found[0] != found[6] and found[12] not in (found[0], found[6])


def test_research_summaries(spark):
    values = spark.createDataFrame([(float(i),) for i in range(1, 7)], "v double")
    got = research.quantile_cohorts(values, "v", ["low", "mid", "high"]).groupBy("cohort").count().collect()
    assert {tuple(r) for r in got} == {("low", 2), ("mid", 2), ("high", 2)}
    m = from_array(spark, np.array([[1.0, 3.0], [0.0, 0.0]]), sparse=True)
    rows = {r.row: r["values"] for r in research.normalized(m, 100, log=False).rows.collect()}
    assert rows == {0: [25.0, 75.0], 1: []}
    points = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 4.0)], "_id string, x double, y double")
    scaled = research.min_max(points, "x", "y")
    assert {tuple(r) for r in research.rectangle_membership(scaled, [("p", 0, 1, 0, 1), ("q", 0.5, 1, 0.5, 1)]).collect()} == {("a", "p"), ("b", "p"), ("b", "q")}
    top = research.variable_features(from_array(spark, X, sparse=True), 2).collect()
    want = X.var(0, ddof=1) / X.mean(0)
    assert [r.col for r in top] == np.argsort(-want)[:2].tolist()
