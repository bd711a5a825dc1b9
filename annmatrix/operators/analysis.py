"""Principal components, neighbour graphs, layouts and clusters of an annotated matrix."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import NameRegistry, PipelineStateValidator
from ..plans.lineage import cut
from ..sources.matrix import Matrix, from_array

#: Rows that meet as one block of a neighbour search.
BLOCK = 4096
#: Edges that layouts and the last rounds of clustering take to the driver at most.
DRIVER_EDGES = 2_000_000


def parameters(target: Any, given: dict) -> dict:
    """What the log says of a run; for a view also which rows it had."""
    return given | ({"view": True, "where": target.where, "n_obs": target.n_obs} if hasattr(target, "where") else {})


def keep(target: Any, uns: dict) -> None:
    target.write_uns({**target.uns, **uns}) if hasattr(target, "write_uns") else target.uns.update(uns)


def note(target: Any, operation: str, slot: str, key: str, given: dict) -> None:
    log = getattr(target, "provenance", None) or getattr(getattr(target, "parent", None), "provenance", None)
    if log is not None:
        log.log(operation, slot, key=key, params=parameters(target, given))


def put(target: Any, slot: str, key: str, matrix: Matrix) -> None:
    method = getattr(target, f"put_{slot}", None)
    method(key, matrix) if method else getattr(target, slot).__setitem__(key, matrix)


def as_vectors(matrix: Matrix, obs: DataFrame) -> DataFrame:
    """row, vector: dense rows as they are, packed rows as sparse vectors; rows without entries are zero."""
    if matrix.kind == "dense":
        return matrix.rows.select("row", array_to_vector(F.col("values").cast("array<double>")).alias("vector"))
    packed, width = matrix.packed().rows, matrix.n_cols
    rows = obs.select(F.col("_pos").alias("row")).join(packed, "row", "left")

    def dense(batches):
        for batch in batches:
            indices, values = batch.column("indices").to_pylist(), batch.column("values").to_pylist()
            out = np.zeros((len(indices), width))
            for i, (at, v) in enumerate(zip(indices, values, strict=True)):
                if at:
                    out[i, at] = v
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * width), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), cells], names=["row", "values"])

    return rows.mapInArrow(dense, "row long, values array<double>").select("row", array_to_vector("values").alias("vector"))


def principal_components(matrix: Matrix, obs: DataFrame, k: int) -> tuple[Matrix, list[float]]:
    """Centred scores on k components, and their shares of the variance.

    The covariance comes from one distributed pass; only features x features numbers reach the driver.
    """
    k = min(k, matrix.n_cols, max(1, matrix.n_rows - 1))
    rows = as_vectors(matrix, obs).persist()
    model = PCA(k=k, inputCol="vector", outputCol="scores").fit(rows)
    scores = model.transform(rows).select("row", vector_to_array("scores").alias("values"))
    middle = scores.select(*[F.avg(F.col("values")[i]).alias(str(i)) for i in range(k)]).first()
    centred = F.transform(F.arrays_zip(F.col("values").alias("v"), F.array(*[F.lit(float(m)) for m in middle]).alias("m")), lambda e: e["v"] - e["m"])
    return Matrix(scores.select("row", centred.alias("values")), "dense", matrix.n_rows, k), [float(v) for v in model.explainedVariance]


def pca(target: Any, n_comps: int = 50, integration: str | None = None, *, layer: str | None = None) -> str:
    """Writes obsm[key] and uns["<key>_variance_ratio"]; returns the key."""
    PipelineStateValidator.validate("pca", target.get_state())
    matrix = target.X if layer is None else target.layers[layer]
    key = NameRegistry.get("pca", integration)
    scores, shares = principal_components(matrix, target.obs, n_comps)
    put(target, "obsm", key, Matrix(scores.rows, "dense", target.n_obs, scores.n_cols))
    keep(target, {f"{key}_variance_ratio": shares})
    note(target, "pca", "obsm", key, {"n_comps": n_comps, "integration": integration})
    return key


def nearest(points: DataFrame, k: int, n: int) -> DataFrame:
    """row, other, distance of the k nearest other rows of points(row, values), exactly; ties to the smaller row.

    Rows are dealt to blocks; each pair of blocks is one multiplication, and gives k candidates a row.
    """
    blocks = max(1, -(-n // BLOCK))
    dealt = points.select("row", "values", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("own"))
    left = dealt.select("row", "values", F.col("own").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = dealt.select("row", "values", F.col("own").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("a"))
    schema = pa.schema([("row", pa.int64()), ("other", pa.int64()), ("distance", pa.float64())])

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        if q.num_rows and x.num_rows:
            a, b = (np.array(t.column("values").to_pylist(), np.float64) for t in (q, x))
            rows, others = q.column("row").to_numpy(), x.column("row").to_numpy()
            order = np.argsort(others)
            b, others = b[order], others[order]
            square = np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)
            square[rows[:, None] == others] = np.inf
            best = np.argsort(square, axis=1, kind="stable")[:, :k]
            far = np.take_along_axis(square, best, 1)
            seen = np.isfinite(far)
            exact = np.sqrt(((a[:, None, :] - b[best]) ** 2).sum(2))
            out = [np.repeat(rows, best.shape[1])[seen.ravel()], others[best].ravel()[seen.ravel()], exact.ravel()[seen.ravel()]]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    met = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(solve, "row long, other long, distance double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "other"))
    return met.withColumn("rank", rank).where(F.col("rank") <= k)


def fuzzy_weights(near: DataFrame, k: int) -> DataFrame:
    """row, other, weight: exp(-(d - rho) / sigma), with rho the nearest distance and sigma such that weights add up to log2(k); symmetrised by a + b - ab."""

    def solve(batches):
        for batch in batches:
            rows, lists = batch.column("row").to_pylist(), batch.column("e").to_pylist()
            out: list[list] = [[], [], []]
            for row, e in zip(rows, lists, strict=True):
                d = np.array([x["distance"] for x in e])
                positive = d[d > 0]
                rho = positive.min() if len(positive) else 0.0
                low, high, sigma = 0.0, np.inf, 1.0
                for _ in range(64):
                    total = np.exp(-np.maximum(d - rho, 0) / sigma).sum()
                    if abs(total - np.log2(k)) < 1e-5:
                        break
                    if total > np.log2(k):
                        high = sigma
                        sigma = (low + high) / 2
                    else:
                        low = sigma
                        sigma = sigma * 2 if np.isinf(high) else (low + high) / 2
                sigma = max(sigma, 1e-3 * (d.mean() if len(d) else 1.0), 1e-12)
                out[0] += [row] * len(e)
                out[1] += [x["other"] for x in e]
                out[2] += np.exp(-np.maximum(d - rho, 0) / sigma).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["row", "other", "weight"])

    lists = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("e"))
    one = lists.mapInArrow(solve, "row long, other long, weight double").persist()
    back = one.select(F.col("other").alias("_r"), F.col("row").alias("_o"), F.col("weight").alias("_w"))
    met = one.join(back, (F.col("row") == F.col("_r")) & (F.col("other") == F.col("_o")), "full")
    a, b = F.coalesce("weight", F.lit(0.0)), F.coalesce("_w", F.lit(0.0))
    return met.select(F.coalesce("row", "_r").alias("row"), F.coalesce("other", "_o").alias("col"), (a + b - a * b).alias("value")).where("value > 0")


def neighbors(target: Any, n_neighbors: int = 15, integration: str | None = None, use_rep: str | None = None) -> str:
    """Writes the distances and connectivities graphs of the nearest rows in an embedding; the row itself counts as its first neighbour."""
    state = target.get_state()
    PipelineStateValidator.validate("neighbors", state)
    rep = use_rep or (key if (key := NameRegistry.get("pca", integration)) in state["obsm_keys"] else "X_pca")
    if rep not in state["obsm_keys"]:
        raise KeyError(f"obsm key {rep!r} not found")
    n = target.n_obs
    near = nearest(target.obsm[rep].rows.select("row", "values"), n_neighbors - 1, n).persist()
    names = {k: NameRegistry.get(k, integration) for k in ("neighbors", "connectivities", "distances")}
    put(target, "obsp", names["distances"], Matrix(near.select("row", F.col("other").cast("int").alias("col"), F.col("distance").alias("value")), "coo", n, n))
    weights = fuzzy_weights(near, n_neighbors)
    put(target, "obsp", names["connectivities"], Matrix(weights.select("row", F.col("col").cast("int").alias("col"), "value"), "coo", n, n))
    keep(target, {"neighbors": {"connectivities_key": names["connectivities"], "distances_key": names["distances"], "params": {"n_neighbors": n_neighbors, "use_rep": rep, "method": "umap"}}})
    note(target, "neighbors", "obsp", names["neighbors"], {"n_neighbors": n_neighbors, "use_rep": rep})
    return names["neighbors"]


def graph_of(target: Any) -> DataFrame:
    info = target.uns.get("neighbors", {})
    key = info.get("connectivities_key", "connectivities")
    if key not in target.obsp:
        raise KeyError(f"obsp key {key!r} not found")
    return target.obsp[key].entries().select(F.col("row").cast("long").alias("a"), F.col("col").cast("long").alias("b"), F.col("value").cast("double").alias("w")).where("a <> b")


def move_round(edges: DataFrame, labels: DataFrame, total: float, resolution: float, turn: int) -> DataFrame:
    """labels(node, c) after one parallel round: half of the nodes, by a hash, move to the neighbouring community of the greatest gain."""
    degree = edges.groupBy("a").agg(F.sum("w").alias("k"))
    own = labels.join(degree, F.col("node") == F.col("a"), "left").select("node", "c", F.coalesce("k", F.lit(0.0)).alias("k"))
    sizes = own.groupBy(F.col("c").alias("sc")).agg(F.sum("k").alias("s"))
    to = edges.join(labels.select(F.col("node").alias("n"), F.col("c").alias("to")), F.col("b") == F.col("n")).groupBy("a", "to").agg(F.sum("w").alias("w"))
    met = own.join(to, F.col("node") == F.col("a")).join(sizes, F.col("to") == F.col("sc"))
    others = F.col("s") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
    gain = F.col("w") - F.lit(resolution / total) * F.col("k") * others
    best = met.withColumn("gain", gain).groupBy("node").agg(F.max(F.struct("gain", F.expr("-to").alias("low"))).alias("g"), F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("stay"))
    stay = F.coalesce("stay", F.lit(0.0))
    pick = best.where(F.col("g.gain") > stay + 1e-12).where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0).select(F.col("node").alias("m"), (-F.col("g.low")).alias("to"))
    return labels.join(pick, F.col("node") == F.col("m"), "left").select("node", F.coalesce("to", "c").alias("c"))


def louvain_small(a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float) -> dict[int, int]:
    """Communities of a graph in memory (edges both ways), by local moves and contraction until nothing improves."""
    names = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(names, a), np.searchsorted(names, b)
    member = np.arange(len(names))
    while True:
        n = int(max(a.max(), b.max())) + 1 if len(a) else 0
        near: list[dict[int, float]] = [{} for _ in range(n)]
        for i, j, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
            near[i][j] = near[i].get(j, 0.0) + x
        degree = np.bincount(a, weights=w, minlength=n)
        total = degree.sum() or 1.0
        c, size = list(range(n)), degree.copy()
        moved = changed = True
        changed = False
        while moved:
            moved = False
            for i in range(n):
                links: dict[int, float] = {}
                for j, x in near[i].items():
                    if j != i:
                        links[c[j]] = links.get(c[j], 0.0) + x
                size[c[i]] -= degree[i]
                best = max(((x - resolution * degree[i] * size[k] / total, k == c[i], -k) for k, x in {**{c[i]: 0.0}, **links}.items()))
                if -best[2] != c[i] and best[0] > links.get(c[i], 0.0) - resolution * degree[i] * size[c[i]] / total + 1e-12:
                    c[i] = -best[2]
                    moved = changed = True
                size[c[i]] += degree[i]
        if not changed:
            break
        _, c = np.unique(np.array(c), return_inverse=True)
        member = c[member]
        pair, at = np.unique(c[a] * (c.max() + 1) + c[b], return_inverse=True)
        w = np.bincount(at, weights=w)
        a, b = pair // (c.max() + 1), pair % (c.max() + 1)
    return dict(zip(names.tolist(), member.tolist(), strict=True))


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, rounds: int = 8) -> DataFrame:
    """node, c: communities of a weighted graph edges(a, b, w), both directions given.

    While the graph is too large for the driver, rounds of parallel local moves are
    followed by contraction, all in tables; a graph of at most
    DRIVER_EDGES edges is finished in memory.
    """
    spark = edges.sparkSession
    member = nodes.select("node", F.col("node").alias("c"))
    now = cut(edges.groupBy("a", "b").agg(F.sum("w").alias("w")))
    size = now.count()
    while size > DRIVER_EDGES:
        total = now.agg(F.sum("w")).first()[0]
        labels = now.select(F.col("a").alias("node")).union(now.select("b")).distinct().withColumn("c", F.col("node"))
        for turn in range(rounds):
            labels = cut(move_round(now, labels, total, resolution, turn))  # else the plan would grow by a power of the rounds
        at = labels.select(F.col("node").alias("n"), F.col("c").alias("to"))
        member = cut(member.join(at, F.col("c") == F.col("n"), "left").select("node", F.coalesce("to", "c").alias("c")))
        new = cut(now.join(at, F.col("a") == F.col("n")).select(F.col("to").alias("a"), "b", "w").join(at, F.col("b") == F.col("n")).groupBy("a", F.col("to").alias("b")).agg(F.sum("w").alias("w")))
        before, size = size, new.count()
        now = new
        if size > 0.9 * before:
            return member
    e = now.orderBy("a", "b").toPandas()
    found = louvain_small(e["a"].to_numpy(np.int64), e["b"].to_numpy(np.int64), e["w"].to_numpy(float), resolution) if len(e) else {}
    table = spark.createDataFrame(list(found.items()), "n long, to long")
    # nodes without edges stay alone
    return member.join(table, F.col("c") == F.col("n"), "left").select("node", F.coalesce(F.col("to"), -1 - F.col("c")).alias("c"))


def leiden(target: Any, resolution: float = 1.0, integration: str | None = None, *, write_back: bool | None = None, output_column: str | None = None) -> str:
    """Cluster labels as text in obs, "0" the largest; a view writes to its parent only if write_back."""
    PipelineStateValidator.validate("leiden", target.get_state())
    column = output_column or NameRegistry.get("leiden", integration)
    found = communities(graph_of(target), target.obs.select(F.col("_pos").alias("node")), resolution)
    sizes = found.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first"))
    names = sizes.select(F.col("c").alias("_c"), (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("string").alias("value"))
    labels = found.join(F.broadcast(names), F.col("c") == F.col("_c")).select(F.col("node").alias("_pos"), "value")
    if hasattr(target, "parent"):
        if write_back:
            ids = target.obs.select("_pos", "_id").join(labels, "_pos").select("_id", "value")
            target.update_obs(column, ids, create=column not in target.parent.obs_columns)
        target.obs = target.obs.drop(column).join(labels.withColumnRenamed("value", column), "_pos", "left")
    elif column in target.obs_columns and hasattr(target, "update_obs"):
        target.update_obs(column, target.obs.select("_pos", "_id").join(labels, "_pos").select("_id", "value"))
    elif hasattr(target, "add_obs_column"):
        target.add_obs_column(column, labels)
    else:
        target.obs = target.obs.drop(column).join(labels.withColumnRenamed("value", column), "_pos", "left")
    note(target, "leiden", "obs", column, {"resolution": resolution, "integration": integration})
    return column


def layout(a: np.ndarray, b: np.ndarray, w: np.ndarray, start: np.ndarray, epochs: int = 200, seed: int = 0) -> np.ndarray:
    """Two coordinates per node: edges attract by weight, random nodes repel, step by falling step."""
    rng = np.random.default_rng(seed)
    y = start.copy()
    strong = w / w.max() if len(w) else w
    for epoch in range(epochs):
        rate = 1.0 - epoch / epochs
        on = rng.random(len(w)) < strong
        i, j = a[on], b[on]
        d = y[i] - y[j]
        far = (d**2).sum(1)
        pull = np.clip((-2 * 1.577 * 0.895 * far ** (0.895 - 1) / (1 + 1.577 * far**0.895))[:, None] * d, -4, 4) if len(i) else d
        pull[~np.isfinite(pull)] = 0
        np.add.at(y, i, rate * pull)
        np.add.at(y, j, -rate * pull)
        for _ in range(3):
            j = rng.integers(0, len(y), len(i))
            d = y[i] - y[j]
            far = (d**2).sum(1)
            push = np.clip((2 * 0.895 / ((0.001 + far) * (1 + 1.577 * far**0.895)))[:, None] * d, -4, 4)
            np.add.at(y, i, rate * push)
    return y


def umap(target: Any, integration: str | None = None, *, epochs: int = 200, seed: int = 0) -> str:
    """Writes a two-dimensional layout of the connectivities to obsm.

    The optimisation runs in the driver's memory, for graphs of at most DRIVER_EDGES
    edges; larger ones are laid out on the rows of the least hashes that keep under that bound,
    and the others are put at the weighted mean of their placed neighbours.
    """
    PipelineStateValidator.validate("umap", target.get_state())
    edges = graph_of(target)
    n, m = target.n_obs, edges.count()
    share = min(1.0, (DRIVER_EDGES / m) ** 0.5) if m else 1.0
    chosen = target.obs.select(F.col("_pos").alias("node"))
    if share < 1:
        chosen = chosen.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(share * 1_000_000))
    inside = edges.join(chosen.select(F.col("node").alias("x")), F.col("a") == F.col("x"), "left_semi").join(chosen.select(F.col("node").alias("x")), F.col("b") == F.col("x"), "left_semi")
    e = inside.orderBy("a", "b").toPandas()
    names = np.sort(chosen.toPandas()["node"].to_numpy(np.int64))
    rng = np.random.default_rng(seed)
    y = layout(np.searchsorted(names, e["a"].to_numpy(np.int64)), np.searchsorted(names, e["b"].to_numpy(np.int64)), e["w"].to_numpy(float), rng.uniform(-10, 10, (len(names), 2)), epochs, seed)
    spark = target.obs.sparkSession
    placed = spark.createDataFrame([(int(i), [float(p[0]), float(p[1])]) for i, p in zip(names, y, strict=True)], "row long, values array<double>")
    if share < 1:
        near = edges.join(placed, F.col("b") == F.col("row")).groupBy("a").agg(*[(F.sum(F.col("w") * F.col("values")[i]) / F.sum("w")).alias(f"p{i}") for i in (0, 1)])
        rest = target.obs.select(F.col("_pos").alias("row")).join(placed.select("row"), "row", "left_anti").join(near, F.col("row") == F.col("a"), "left")
        placed = placed.union(rest.select("row", F.array(F.coalesce("p0", F.lit(0.0)), F.coalesce("p1", F.lit(0.0)))))
    key = NameRegistry.get("umap", integration)
    put(target, "obsm", key, Matrix(placed, "dense", n, 2))
    note(target, "umap", "obsm", key, {"integration": integration})
    return key


def variance_shares(entries: DataFrame, groups: DataFrame, width: int, k: int = 5) -> DataFrame:
    """group, rank, share: the first k variance shares of each group's centred rows, groups solved side by side.

    entries(row, col, value) and groups(row, group).  What is solved per group is its
    features x features scatter matrix, summed up in tables, so a large group isn't gathered anywhere.
    """
    tagged = entries.join(groups.select(F.col("row").alias("_r"), "group"), F.col("row") == F.col("_r")).select("group", "row", "col", F.col("value").cast("double").alias("v"))
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    sums = tagged.groupBy("group", "col").agg(F.sum("v").alias("s"))
    other = tagged.select(F.col("group").alias("g2"), F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("v").alias("v2"))
    products = tagged.join(other, (F.col("row") == F.col("r2")) & (F.col("group") == F.col("g2"))).groupBy("group", "col", "c2").agg(F.sum(F.col("v") * F.col("v2")).alias("p"))
    parts = products.select("group", "col", "c2", "p").unionByName(sums.select("group", "col", F.lit(-1).alias("c2"), F.col("s").alias("p")))
    lists = parts.groupBy("group").agg(F.collect_list(F.struct("col", "c2", "p")).alias("e")).join(sizes, "group")

    def solve(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for g, e, n in zip(batch.column("group").to_pylist(), batch.column("e").to_pylist(), batch.column("n").to_pylist(), strict=True):
                m, s = np.zeros((width, width)), np.zeros(width)
                for x in e:
                    if x["c2"] < 0:
                        s[x["col"]] = x["p"]
                    else:
                        m[x["col"], x["c2"]] = x["p"]
                values = np.linalg.eigvalsh(m - np.outer(s, s) / n)[::-1].clip(0)
                shares = values / values.sum() if values.sum() else values
                out[0] += [g] * min(k, width)
                out[1] += range(1, min(k, width) + 1)
                out[2] += shares[:k].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("group").type), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64())], names=["group", "rank", "share"])

    kind = groups.schema["group"].dataType.simpleString()
    return lists.select("group", "e", "n").mapInArrow(solve, f"group {kind}, rank int, share double")


__all__ = ["communities", "fuzzy_weights", "from_array", "leiden", "nearest", "neighbors", "pca", "principal_components", "umap", "variance_shares"]
