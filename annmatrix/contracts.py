"""The registered queries over the driver's tables, each with its SQL.

The tables are seen as annotated matrices: orders with their customers as rows,
parts as features and line quantities as the matrix; embeddings as a dense one; users by
event types; and documents with their labels as metadata with missing groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import analysis, research, workflows
from .operators.tasks import AggregateTask, MaterializeTask
from .plans.lineage import shared_folder
from .sources.dataset import Dataset
from .sources.matrix import Matrix, read_matrix_market, write_matrix_market
from .sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> Dataset:
    """Orders x parts: quantities, and prices as a layer."""
    orders, customer, part, item = (read(spark, sf_dir, t) for t in ("orders", "customer", "part", "lineitem"))
    obs = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    obs = obs.select(F.col("o_orderkey").alias("_pos"), F.col("o_orderkey").cast("string").alias("_id"), "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority", "c_nationkey", "c_mktsegment", "c_acctbal")
    var = part.select(F.col("p_partkey").alias("_pos"), F.concat(F.lit("p"), F.col("p_partkey")).alias("_id"), "p_name", "p_brand", "p_type", "p_size")

    def matrix(column: str) -> Matrix:
        entries = item.select(F.col("l_orderkey").alias("row"), F.col("l_partkey").cast("int").alias("col"), F.col(column).alias("value"))
        # an order may hold a part twice; such places are added up where it matters
        return Matrix(entries, "coo", 1 << 62, 1 << 31, unique=False)

    return Dataset(obs, var, matrix("l_quantity"), layers={"price": matrix("l_extendedprice")})


def vectors(spark: SparkSession, sf_dir: str) -> Dataset:
    """Embeddings as a dense matrix; features are their dimensions."""
    table = read(spark, sf_dir, "embeddings")
    width = table.agg(F.max(F.size("embedding"))).first()[0] or 0
    obs = table.select(F.col("vec_id").alias("_pos"), F.col("vec_id").cast("string").alias("_id"), "label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    var = spark.range(width).select(F.col("id").alias("_pos"), F.concat(F.lit("d"), F.col("id")).alias("_id"))
    rows = table.select(F.col("vec_id").alias("row"), F.col("embedding").alias("values"))
    return Dataset(obs, var, Matrix(rows, "dense", 1 << 62, width))


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def users(spark: SparkSession, sf_dir: str) -> Dataset:
    """Users x event types: sums of values."""
    events = read(spark, sf_dir, "events")
    obs = events.select(F.col("user_id").alias("_pos")).distinct().select("_pos", F.col("_pos").cast("string").alias("_id"), (F.col("_pos") % 4).cast("int").alias("cohort"))
    names = F.array(*[F.lit(t) for t in EVENT_TYPES])
    var = spark.createDataFrame([(i, t) for i, t in enumerate(EVENT_TYPES)], "_pos long, _id string")
    entries = events.select(F.col("user_id").alias("row"), (F.array_position(names, F.col("event_type")) - 1).cast("int").alias("col"), "value")
    return Dataset(obs, var, Matrix(entries, "coo", 1 << 62, len(EVENT_TYPES), unique=False))


def labelled(spark: SparkSession, sf_dir: str) -> Dataset:
    """Documents with their labels, where they have some: metadata without a matrix."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    obs = docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")
    quality = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return Dataset(obs.select(F.col("doc_id").alias("_pos"), F.col("doc_id").cast("string").alias("_id"), "lang", "source", "n_chars", quality.alias("quality")))


def store_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"


def stored(data: Dataset) -> Store:
    """A store of a dataset in the shared folder."""
    return Store.from_dataset(data, store_path(data.spark))


def rounded(column: str, digits: int = 4):
    return F.round(F.col(column).cast("double"), digits)


OBS = """obs AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, c_nationkey, c_mktsegment, c_acctbal FROM orders JOIN customer ON o_custkey = c_custkey),
x AS (SELECT l_orderkey AS r, l_partkey AS c, sum(l_quantity) AS v, sum(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2)"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg_mean_implicit_zero(spark, sf_dir)


# predicates, views, selections
@query(f"WITH {OBS} SELECT o_orderkey AS pos, o_orderstatus, o_totalprice FROM obs WHERE o_orderstatus IN ('F', 'P') AND o_totalprice > 250000 AND starts_with(o_orderpriority, '1')")
def obs_filter_project(spark, sf_dir):
    view = lines(spark, sf_dir).query_obs('"o_orderstatus" IN (?, ?) AND "o_totalprice" > ? AND starts_with("o_orderpriority", ?)', ["F", "P", 250000, "1"], ["o_orderstatus", "o_totalprice"])
    return view.obs.select(F.col("_pos").alias("pos"), "o_orderstatus", "o_totalprice")


@query(f"WITH {OBS} SELECT o_orderkey AS pos, c_mktsegment FROM obs WHERE (CAST(c_nationkey AS VARCHAR) = '7' OR c_nationkey // 5 = 2) AND c_mktsegment = 'BUILDING' AND o_totalprice BETWEEN 1000 AND 300000")
def view_refine(spark, sf_dir):
    view = lines(spark, sf_dir).query_obs('CAST("c_nationkey" AS VARCHAR) = ? OR "c_nationkey" // 5 = 2', ["7"])
    return view.query_obs('"c_mktsegment" = ?', ["BUILDING"]).refine('"o_totalprice" BETWEEN ? AND ?', [1000, 300000], ["c_mktsegment"]).obs.select(F.col("_pos").alias("pos"), "c_mktsegment")


@query(f"WITH {OBS} SELECT CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'home' WHEN c_mktsegment = 'MACHINERY' THEN 'work' END AS part, count(*) AS n, min(o_orderkey) AS first FROM obs WHERE c_mktsegment IN ('BUILDING', 'FURNITURE', 'MACHINERY') GROUP BY 1")
def partition_obs(spark, sf_dir):
    views = lines(spark, sf_dir).partition_obs("c_mktsegment", {"home": ["BUILDING", "FURNITURE"], "work": "MACHINERY"})
    parts = [v.obs.agg(F.count(F.lit(1)).alias("n"), F.min("_pos").alias("first")).select(F.lit(n).alias("part"), "n", "first") for n, v in views.items()]
    return parts[0].union(parts[1])


@query(f"WITH {OBS} SELECT o_orderkey AS pos, r AS entry_row, c AS feature, v AS value FROM obs JOIN x ON r = o_orderkey WHERE o_orderkey IN (1, 3, 5, 8, 13, 21, 34, 55, 89, 144) AND o_orderstatus <> 'P'")
def cell_ids_semijoin(spark, sf_dir):
    data = lines(spark, sf_dir)
    ids = [r[0] for r in data.obs.where(F.col("_pos").isin(1, 3, 5, 8, 13, 21, 34, 55, 89, 144) & (F.col("o_orderstatus") != "P")).select("_id").collect()]
    run = data.execute_tasks([MaterializeTask("chosen", '"o_orderstatus" <> ?', ["P"], cell_ids=ids)])
    got = run["chosen"]
    return got.entries.join(got.obs.select("_pos", "_id"), F.col("row") == F.col("_pos")).select(F.col("_id").cast("long").alias("pos"), F.col("_id").cast("long").alias("entry_row"), F.col("col").cast("long").alias("feature"), "value")


@query(f"WITH {OBS}, f(name, place, c) AS (VALUES ('p40', 0, 40), ('p3', 1, 3), ('p17', 2, 17)) SELECT place, name AS feature, count(*) AS n, sum(v) AS total FROM x JOIN f USING (c) GROUP BY 1, 2")
def feature_select(spark, sf_dir):
    data = lines(spark, sf_dir)
    got = data.execute_tasks([MaterializeTask("all", features=["p40", "p3", "p17"])])["all"]
    return got.entries.join(F.broadcast(got.var.select(F.col("_pos").alias("place"), F.col("_id").alias("feature"))), F.col("col") == F.col("place")).groupBy("place", "feature").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("WITH e AS (SELECT o_custkey AS a, o_orderkey % 1000 AS b, count(*) AS w FROM orders GROUP BY 1, 2) SELECT a AS src, b AS dst, w AS weight FROM e JOIN customer ca ON a = ca.c_custkey JOIN customer cb ON b = cb.c_custkey WHERE ca.c_mktsegment = 'BUILDING' AND cb.c_mktsegment = 'BUILDING'")
def induced_subgraph(spark, sf_dir):
    customer, orders = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    obs = customer.select(F.col("c_custkey").alias("_pos"), F.col("c_custkey").cast("string").alias("_id"), "c_mktsegment")
    edges = orders.groupBy(F.col("o_custkey").alias("row"), (F.col("o_orderkey") % 1000).cast("int").alias("col")).agg(F.count(F.lit(1)).alias("value"))
    view = Dataset(obs, obsp={"links": Matrix(edges, "coo", 1 << 31, 1 << 31)}).query_obs("c_mktsegment = ?", ["BUILDING"])
    return view.obsp["links"].entries().select(F.col("row").alias("src"), F.col("col").cast("long").alias("dst"), F.col("value").alias("weight"))


# changes, as new metadata tables
@query(f"WITH {OBS} SELECT o_orderkey AS pos, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM obs")
def update_obs_join(spark, sf_dir):
    store = stored(Dataset(lines(spark, sf_dir).obs))
    store.update_obs("o_orderstatus", store.obs.where("_pos % 10 = 0").select("_id", F.lit("X").alias("value")))
    return store.obs.select(F.col("_pos").alias("pos"), "o_orderstatus")


@query(f"WITH {OBS} SELECT o_orderkey AS pos, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus FROM obs")
def update_obs_where(spark, sf_dir):
    store = stored(Dataset(lines(spark, sf_dir).obs))
    store.update_obs_where("o_orderstatus", "Z", '"o_orderstatus" = ? AND "o_totalprice" > ?', ["F", 100000])
    return store.obs.select(F.col("_pos").alias("pos"), "o_orderstatus")


@query(f"WITH {OBS}, t AS (SELECT r, sum(v) AS q FROM x GROUP BY 1) SELECT o_orderkey AS pos, o_orderstatus, coalesce(q, 0) AS quantity FROM obs LEFT JOIN t ON r = o_orderkey")
def add_obs_column(spark, sf_dir):
    data = lines(spark, sf_dir)
    store = stored(Dataset(data.obs))
    totals = data.X.totals().select(F.col("row").alias("at"), "total")
    store.add_obs_column("quantity", store.obs.select("_pos").join(totals, F.col("_pos") == F.col("at"), "left").select("_pos", F.coalesce("total", F.lit(0.0)).alias("value")))
    return store.obs.select(F.col("_pos").alias("pos"), "o_orderstatus", "quantity")


@query(f"WITH {OBS} SELECT o_orderkey AS pos, o_totalprice FROM obs WHERE o_orderstatus = 'P'")
def named_view(spark, sf_dir):
    store = stored(Dataset(lines(spark, sf_dir).obs))
    store.save_view("open", store.query_obs('"o_orderstatus" = ?', ["P"], ["o_totalprice"]))
    store.reload()
    return store.load_view("open").obs.select(F.col("_pos").alias("pos"), "o_totalprice")


@query(f"WITH {OBS}, n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM obs WHERE o_orderstatus = 'P') SELECT row, c AS feature, v AS value FROM n JOIN x ON r = o_orderkey WHERE v <> 0")
def view_materialize(spark, sf_dir):
    data = lines(spark, sf_dir)
    made = Dataset(data.obs, data.var, data.X).query_obs('"o_orderstatus" = ?', ["P"], ["o_totalprice"]).materialize(store_path(spark))
    return made.X.entries().select("row", F.col("col").cast("long").alias("feature"), "value")


@query(f"WITH {OBS} SELECT o_orderpriority, 'p' || c AS feature, round(sum(v), 4) AS sum, count(*) AS count_nonzero FROM obs JOIN x ON r = o_orderkey WHERE v <> 0 GROUP BY 1, 2")
def agg_packed_rows(spark, sf_dir):
    """The same aggregation over packed sparse rows, as a store keeps them."""
    data = lines(spark, sf_dir)
    store = stored(Dataset(data.obs, data.var, data.X))
    got = store.aggregate_many([AggregateTask("t", "o_orderpriority", metrics=("sum", "count_nonzero"))])["t"]
    return got.stats.join(got.groups.select("group_idx", "o_orderpriority"), "group_idx").select("o_orderpriority", "feature", rounded("sum").alias("sum"), "count_nonzero")


@query(f"WITH {OBS} SELECT r AS row, c AS col, v AS value FROM x WHERE v <> 0")
def mtx_round_trip(spark, sf_dir):
    path = store_path(spark)
    write_matrix_market(lines(spark, sf_dir).X, path)
    return read_matrix_market(spark, path).entries().select("row", F.col("col").cast("long").alias("col"), "value")


# aggregations
def dense(result, *metrics: str) -> DataFrame:
    keys = [c for c in result.groups.columns if c not in ("group", "view_id")]
    table = result.dense().join(F.broadcast(result.groups.select(*keys)), "group_idx")
    return table.select(*keys, "feature", *[rounded(m).alias(m) if m != "count_nonzero" else F.col(m) for m in metrics])


GRID = "g AS (SELECT {keys}, count(*) AS n_cells, {order} AS first FROM obs {where} GROUP BY {keys}), i AS (SELECT *, CAST(row_number() OVER (ORDER BY {rank}) - 1 AS INTEGER) AS group_idx FROM g), f AS (SELECT p_partkey AS c, 'p' || p_partkey AS feature FROM part)"


@query(f"WITH {OBS}, {GRID.format(keys='o_orderstatus', order='min(o_orderkey)', where='', rank='first')}, s AS (SELECT o_orderstatus, c, sum(v) AS t FROM obs JOIN x ON r = o_orderkey GROUP BY 1, 2) SELECT group_idx, i.o_orderstatus, n_cells, feature, round(coalesce(t, 0), 4) AS sum FROM i CROSS JOIN f LEFT JOIN s ON s.o_orderstatus = i.o_orderstatus AND s.c = f.c")
def agg_sum(spark, sf_dir):
    return dense(lines(spark, sf_dir).aggregate_many([AggregateTask("t", "o_orderstatus")])["t"], "sum")


@query(f"WITH {OBS}, {GRID.format(keys='c_mktsegment', order='min(o_orderkey)', where=chr(87) + 'HERE o_orderstatus = ' + chr(39) + 'F' + chr(39), rank='first')}, s AS (SELECT c_mktsegment, c, sum(v) AS t, count(*) AS n FROM obs JOIN x ON r = o_orderkey WHERE o_orderstatus = 'F' AND v <> 0 GROUP BY 1, 2) SELECT group_idx, i.c_mktsegment, n_cells, feature, round(coalesce(t, 0), 4) AS sum, round(coalesce(t, 0) / n_cells, 4) AS mean, coalesce(n, 0) AS count_nonzero FROM i CROSS JOIN f LEFT JOIN s ON s.c_mktsegment = i.c_mktsegment AND s.c = f.c")
def agg_mean_implicit_zero(spark, sf_dir):
    task = AggregateTask("t", "c_mktsegment", metrics=("sum", "mean", "count_nonzero"), where='"o_orderstatus" = ?', params=["F"])
    return dense(lines(spark, sf_dir).aggregate_many([task])["t"], "sum", "mean", "count_nonzero")


@query(f"WITH {OBS} SELECT o_orderpriority, 'p' || c AS feature, count(*) AS count_nonzero FROM obs JOIN x ON r = o_orderkey WHERE v <> 0 GROUP BY 1, 2")
def agg_count_nonzero(spark, sf_dir):
    got = lines(spark, sf_dir).aggregate_many([AggregateTask("t", "o_orderpriority", metrics="count_nonzero")])["t"]
    return got.stats.join(F.broadcast(got.groups.select("group_idx", "o_orderpriority")), "group_idx").select("o_orderpriority", "feature", "count_nonzero")


@query("WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings), n AS (SELECT label, count(*) AS n_cells FROM embeddings GROUP BY 1) SELECT e.label, n_cells, 'd' || d AS feature, round(sum(CAST(v AS DOUBLE)), 4) + 0.0 AS sum, round(sum(CAST(v AS DOUBLE)) / n_cells, 4) + 0.0 AS mean, count(CASE WHEN v <> 0 THEN 1 END) AS count_nonzero FROM e JOIN n USING (label) GROUP BY 1, 2, 3")
def agg_dense_vector(spark, sf_dir):
    got = vectors(spark, sf_dir).aggregate_many([AggregateTask("t", "label", metrics=("sum", "mean", "count_nonzero"))])["t"]
    return got.dense().join(F.broadcast(got.groups.select("group_idx", "label", "n_cells")), "group_idx").select("label", "n_cells", "feature", (rounded("sum") + 0.0).alias("sum"), (rounded("mean") + 0.0).alias("mean"), "count_nonzero")


@query("SELECT lang, source, count(*) AS n_cells FROM documents GROUP BY 1, 2")
def agg_metadata_only(spark, sf_dir):
    return labelled(spark, sf_dir).aggregate_many([AggregateTask("t", ["lang", "source"], metrics=())])["t"].groups.select("lang", "source", "n_cells")


@query("WITH o AS (SELECT doc_id, CASE quality WHEN 1 THEN 'good' WHEN 0 THEN 'poor' END AS quality FROM documents LEFT JOIN labels USING (doc_id)), g AS (SELECT quality, count(*) AS n_cells, min(doc_id) AS first FROM o GROUP BY 1) SELECT CAST(row_number() OVER (ORDER BY quality IS NULL, first) - 1 AS INTEGER) AS group_idx, coalesce(quality, '<NA>') AS quality, n_cells FROM g")
def agg_missing_group(spark, sf_dir):
    return labelled(spark, sf_dir).aggregate_many([AggregateTask("t", "quality", metrics=())])["t"].groups.select("group_idx", "quality", "n_cells")


@query(f"WITH {OBS}, g AS (SELECT o_orderpriority, c_mktsegment, count(*) AS n_cells, min(o_orderkey) AS first FROM obs GROUP BY 1, 2), l AS (SELECT *, list_position(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], o_orderpriority) AS a, min(first) OVER (PARTITION BY c_mktsegment) AS b FROM g) SELECT CAST(row_number() OVER (ORDER BY a, b) - 1 AS INTEGER) AS group_idx, o_orderpriority, c_mktsegment, n_cells FROM l")
def agg_multicolumn_ordered(spark, sf_dir):
    data = lines(spark, sf_dir)
    levels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    data.obs = data.obs.withColumn("o_orderpriority", F.col("o_orderpriority").alias("o_orderpriority", metadata={"categories": levels, "ordered": True}))
    got = data.aggregate_many([AggregateTask("t", ["o_orderpriority", "c_mktsegment"], metrics=())])["t"]
    return got.groups.select("group_idx", "o_orderpriority", "c_mktsegment", "n_cells")


def joint(run, names: list[str]) -> DataFrame:
    out = None
    for n in names:
        got = run[n]
        one = got.stats.join(F.broadcast(got.groups.select("group_idx", "n_cells")), "group_idx").groupBy("group_idx", "n_cells").agg(F.sum("sum").alias("sum"), F.sum("count_nonzero").alias("count_nonzero"))
        one = one.select(F.lit(n).alias("task"), "group_idx", "n_cells", rounded("sum").alias("sum"), "count_nonzero")
        out = one if out is None else out.union(one)
    return out


def task_sql(name: str, key: str, where: str = "TRUE") -> str:
    return f"""SELECT '{name}' AS task, group_idx, n_cells, round(t, 4) AS sum, n AS count_nonzero FROM (
  SELECT {key} AS k, count(*) AS n_cells, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS INTEGER) AS group_idx FROM obs WHERE {where} GROUP BY 1)
  JOIN (SELECT {key} AS k, sum(v) AS t, count(*) AS n FROM obs JOIN x ON r = o_orderkey WHERE {where} AND v <> 0 GROUP BY 1) USING (k)"""


@query(f"WITH {OBS} " + " UNION ALL ".join([task_sql("status", "o_orderstatus"), task_sql("segment", "c_mktsegment"), task_sql("priority", "o_orderpriority")]))
def agg_joint_tasks(spark, sf_dir):
    tasks = [AggregateTask(n, c, metrics=("sum", "mean", "count_nonzero")) for n, c in (("status", "o_orderstatus"), ("segment", "c_mktsegment"), ("priority", "o_orderpriority"))]
    return joint(lines(spark, sf_dir).aggregate_many(tasks), ["status", "segment", "priority"])


@query(f"WITH {OBS} " + " UNION ALL ".join([task_sql("high", "c_mktsegment", "o_totalprice > 200000"), task_sql("late", "o_orderstatus", "o_orderdate >= TIMESTAMP '1996-01-01'"), task_sql("both", "o_orderpriority", "o_totalprice > 200000 AND o_orderstatus = 'F'")]))
def agg_overlap_cohorts(spark, sf_dir):
    tasks = [
        AggregateTask("high", "c_mktsegment", metrics=("sum", "count_nonzero"), where='"o_totalprice" > ?', params=[200000]),
        AggregateTask("late", "o_orderstatus", metrics=("sum", "count_nonzero"), where="\"o_orderdate\" >= TIMESTAMP_NTZ '1996-01-01 00:00:00'"),
        AggregateTask("both", "o_orderpriority", metrics=("sum", "count_nonzero"), where='"o_totalprice" > ? AND "o_orderstatus" = ?', params=[200000, "F"]),
    ]
    return joint(lines(spark, sf_dir).aggregate_many(tasks), ["high", "late", "both"])


@query(f"WITH {OBS}, m AS (SELECT o_orderkey, o_orderpriority AS scope FROM obs UNION ALL SELECT o_orderkey, c_mktsegment FROM obs), n AS (SELECT scope, count(*) AS n_cells FROM m GROUP BY 1) SELECT scope, n_cells, round(sum(v), 4) AS sum, round(sum(v) / n_cells, 4) AS mean FROM m JOIN n USING (scope) JOIN x ON r = o_orderkey GROUP BY 1, 2")
def agg_membership_overlap(spark, sf_dir):
    data = lines(spark, sf_dir)
    edges = data.obs.select(F.col("_id").alias("cell_id"), F.explode(F.array("o_orderpriority", "c_mktsegment")).alias("scope"))
    got = data.aggregate_many([AggregateTask("t", "scope", membership=edges)])["t"]
    stats = got.stats.groupBy("group_idx").agg(F.sum("sum").alias("sum"))
    met = got.groups.select("group_idx", "scope", "n_cells").join(stats, "group_idx")
    return met.select("scope", "n_cells", rounded("sum").alias("sum"), F.round(F.col("sum") / F.col("n_cells"), 4).alias("mean"))


@query(f"WITH {OBS} SELECT o_orderstatus, 'p' || c AS feature, round(sum(price), 2) AS sum FROM obs JOIN x ON r = o_orderkey WHERE c IN (5, 2, 11) GROUP BY 1, 2")
def agg_layer_features(spark, sf_dir):
    got = lines(spark, sf_dir).aggregate_many([AggregateTask("t", "o_orderstatus", source="layers:price", features=["p5", "p2", "p11"])])["t"]
    return got.stats.join(F.broadcast(got.groups.select("group_idx", "o_orderstatus")), "group_idx").select("o_orderstatus", "feature", rounded("sum", 2).alias("sum"))


# materialisation and mixed runs
@query(f"WITH {OBS}, c AS (SELECT 'high' AS name, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM obs WHERE o_totalprice > 400000 UNION ALL SELECT 'urgent', o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 FROM obs WHERE o_orderpriority = '1-URGENT') SELECT name, row, c AS col, v AS value FROM c JOIN x ON r = o_orderkey".replace("c AS col", "x.c AS col"))
def materialize_many(spark, sf_dir):
    data = lines(spark, sf_dir)
    views = {"high": data.query_obs('"o_totalprice" > ?', [400000]), "urgent": data.query_obs('"o_orderpriority" = ?', ["1-URGENT"])}
    return data.materialize_many(views).select("name", "row", F.col("col").cast("long").alias("col"), "value")


@query(f"WITH {OBS}, a AS ({task_sql('status', 'o_orderstatus')}) SELECT * FROM a UNION ALL SELECT 'rows', 0, (SELECT count(*) FROM obs WHERE c_mktsegment = 'MACHINERY'), round(sum(v), 4), count(*) FROM obs JOIN x ON r = o_orderkey WHERE c_mktsegment = 'MACHINERY'")
def execute_mixed(spark, sf_dir):
    data = lines(spark, sf_dir)
    run = data.execute_tasks([AggregateTask("status", "o_orderstatus", metrics=("sum", "count_nonzero")), MaterializeTask("rows", '"c_mktsegment" = ?', ["MACHINERY"])])
    got = run["rows"]
    rows = got.entries.agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count_nonzero")).select(F.lit("rows").alias("task"), F.lit(0).alias("group_idx"), F.lit(got.n_obs).cast("long").alias("n_cells"), rounded("sum").alias("sum"), "count_nonzero")
    return joint(run, ["status"]).union(rows)


@query(f"WITH {OBS}, a AS (SELECT o_orderkey FROM obs WHERE o_totalprice > 200000), b AS (SELECT o_orderkey FROM obs WHERE o_orderstatus = 'F'), n AS (SELECT (SELECT count(*) FROM a) + (SELECT count(*) FROM b) AS requested_rows, (SELECT count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)) AS unique_rows) SELECT requested_rows, unique_rows, requested_rows - unique_rows AS overlap_rows, CAST(1 AS BIGINT) AS scans FROM n")
def shared_union_counts(spark, sf_dir):
    tasks = [AggregateTask("high", "c_mktsegment", where='"o_totalprice" > ?', params=[200000]), AggregateTask("f", "c_mktsegment", where='"o_orderstatus" = ?', params=["F"])]
    report = lines(spark, sf_dir).aggregate_many(tasks).report
    return spark.createDataFrame([(report.requested_rows, report.unique_rows, report.overlap_rows, report.source_scan_count)], "requested_rows long, unique_rows long, overlap_rows long, scans long")


# cohorts and summaries
@query(f"WITH {OBS} SELECT r AS pos, sum(v) AS total, count(*) AS nnz FROM x WHERE v <> 0 GROUP BY 1")
def row_totals(spark, sf_dir):
    data = lines(spark, sf_dir)
    summed = Matrix(data.X.single(data.X.entries()), "coo", 1 << 62, 1 << 31)
    return summed.totals().select(F.col("row").alias("pos"), "total", "nnz")


@query(f"WITH {OBS}, t AS (SELECT r, sum(v) AS total FROM x GROUP BY 1), q AS (SELECT quantile_cont(total, 1.0 / 3) AS a, quantile_cont(total, 2.0 / 3) AS b FROM t) SELECT CASE WHEN total <= a THEN 'lower' WHEN total <= b THEN 'middle' ELSE 'upper' END AS cohort, count(*) AS n, sum(total) AS total FROM t CROSS JOIN q GROUP BY 1")
def tertile_cohorts(spark, sf_dir):
    totals = lines(spark, sf_dir).X.totals()
    return research.quantile_cohorts(totals, "total", ["lower", "middle", "upper"]).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("total"))


@query(f"WITH {OBS} SELECT DISTINCT c_nationkey, c_mktsegment FROM obs WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 450000 INTERSECT SELECT DISTINCT c_nationkey, c_mktsegment FROM obs WHERE o_orderpriority = '5-LOW' AND o_totalprice > 450000")
def matched_strata(spark, sf_dir):
    view = lines(spark, sf_dir).query_obs('"o_totalprice" > ?', [450000])
    return research.matched_strata(view.obs, ["c_nationkey", "c_mktsegment"], "o_orderpriority", "5-LOW", "1-URGENT")


@query(f"WITH {OBS}, p(arm) AS (VALUES ('5-LOW'), ('1-URGENT')), n AS (SELECT c_mktsegment, o_orderpriority AS arm, count(*) AS n FROM obs GROUP BY 1, 2), s AS (SELECT c_mktsegment, o_orderpriority AS arm, c, sum(v) AS t FROM obs JOIN x ON r = o_orderkey GROUP BY 1, 2, 3), f AS (SELECT p_partkey AS c FROM part), m AS (SELECT n.c_mktsegment, n.arm, f.c, coalesce(t, 0) / n AS m FROM n JOIN p USING (arm) CROSS JOIN f LEFT JOIN s ON s.c_mktsegment = n.c_mktsegment AND s.arm = n.arm AND s.c = f.c), d AS (SELECT a.c, a.m - b.m AS d FROM m a JOIN m b ON a.c = b.c AND a.c_mktsegment = b.c_mktsegment AND a.arm = '1-URGENT' AND b.arm = '5-LOW') SELECT 'p' || c AS feature, round(avg(d), 6) AS mean_matched_difference, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS positive_pair_fraction, count(*) AS n_pairs FROM d GROUP BY 1")
def matched_response(spark, sf_dir):
    task = AggregateTask("t", ["c_mktsegment", "o_orderpriority"], metrics=("sum", "count_nonzero"), where='"o_orderpriority" IN (?, ?)', params=["5-LOW", "1-URGENT"])
    got = lines(spark, sf_dir).aggregate_many([task])["t"]
    out = research.matched_response(got, ["c_mktsegment"], "o_orderpriority", "5-LOW", "1-URGENT")
    return out.select("feature", rounded("mean_matched_difference", 6).alias("mean_matched_difference"), rounded("positive_pair_fraction", 6).alias("positive_pair_fraction"), "n_pairs")


@query(f"WITH {OBS}, n AS (SELECT c_nationkey, o_orderstatus AS arm, count(*) AS n FROM obs WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2), s AS (SELECT c_nationkey, o_orderstatus AS arm, c, sum(v) AS t FROM obs JOIN x ON r = o_orderkey GROUP BY 1, 2, 3), m AS (SELECT n.arm, s.c, sum(t / n) AS m FROM n JOIN s ON s.c_nationkey = n.c_nationkey AND s.arm = n.arm GROUP BY 1, 2), k AS (SELECT arm, count(*) AS k FROM n GROUP BY 1), d AS (SELECT p_partkey AS c, coalesce(a.m, 0) / (SELECT k FROM k WHERE arm = 'F') - coalesce(b.m, 0) / (SELECT k FROM k WHERE arm = 'O') AS d FROM part LEFT JOIN (SELECT * FROM m WHERE arm = 'F') a ON a.c = p_partkey LEFT JOIN (SELECT * FROM m WHERE arm = 'O') b ON b.c = p_partkey) SELECT feature_pos, feature, mean_difference FROM (SELECT CAST(c AS INTEGER) AS feature_pos, 'p' || c AS feature, round(d, 6) AS mean_difference, row_number() OVER (ORDER BY round(d, 9) DESC, c) AS i FROM d) WHERE i <= 10")
def subtype_contrast_topk(spark, sf_dir):
    task = AggregateTask("t", ["c_nationkey", "o_orderstatus"], metrics="mean", where='"o_orderstatus" IN (?, ?)', params=["F", "O"])
    got = lines(spark, sf_dir).aggregate_many([task])["t"]
    table = research.contrast(got, "o_orderstatus", "O", "F").withColumn("mean_difference", F.round("mean_difference", 9))
    return research.top_features(table, "mean_difference", 10).select("feature_pos", "feature", rounded("mean_difference", 6).alias("mean_difference"))


@query("WITH e AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), m AS (SELECT e.label, d, round(sum(CAST(v AS DOUBLE)) / any_value(n), 9) AS m FROM e JOIN n USING (label) GROUP BY 1, 2) SELECT label, CAST(rank AS INTEGER) AS rank, 'd' || d AS feature, round(m, 5) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY m DESC, d) AS rank FROM m) WHERE rank <= 3")
def top_markers_per_group(spark, sf_dir):
    got = vectors(spark, sf_dir).aggregate_many([AggregateTask("t", "label", metrics="mean")])["t"]
    got.stats = got.stats.withColumn("mean", F.round("mean", 9))
    top = research.top_per_group(got, "mean", 3).join(F.broadcast(got.groups.select("group_idx", "label")), "group_idx")
    return top.select("label", "rank", "feature", rounded("value", 5).alias("mean"))


@query("SELECT source AS value, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def largest_scopes(spark, sf_dir):
    return research.largest_groups(read(spark, sf_dir, "documents"), "source", 5)


@query(f"WITH {OBS}, s AS (SELECT c_mktsegment AS donor, sum(v) AS t FROM obs JOIN x ON r = o_orderkey GROUP BY 1), n AS (SELECT c_mktsegment AS donor, count(*) AS n FROM obs GROUP BY 1) SELECT a.donor AS left_out, CAST(sum(n) AS BIGINT) AS n_cells, round(sum(t), 4) AS sum FROM n a JOIN n b ON a.donor <> b.donor JOIN s ON s.donor = b.donor GROUP BY 1".replace("sum(n)", "sum(b.n)"))
def leave_one_out(spark, sf_dir):
    bulk = lines(spark, sf_dir).aggregate_many([AggregateTask("t", "c_mktsegment")])["t"]
    out = None
    for donor, rest in workflows.leave_one_out_pseudobulk(bulk, donor_column="c_mktsegment").items():
        one = rest.groups.agg(F.sum("n_cells").alias("n_cells")).crossJoin(rest.stats.agg(F.sum("sum").alias("sum")))
        one = one.select(F.lit(donor).alias("left_out"), "n_cells", rounded("sum").alias("sum"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {OBS} SELECT 'quantity' AS modality, o_orderstatus, round(sum(v), 2) AS sum FROM obs JOIN x ON r = o_orderkey GROUP BY 2 UNION ALL SELECT 'price', o_orderstatus, round(sum(price), 2) FROM obs JOIN x ON r = o_orderkey GROUP BY 2")
def aggregate_modalities(spark, sf_dir):
    data = lines(spark, sf_dir)
    run = workflows.aggregate_modalities({"quantity": data, "price": data}, groupby="o_orderstatus", sources={"price": "layers:price"})
    out = None
    for n, got in run.results.items():
        one = got.stats.join(F.broadcast(got.groups.select("group_idx", "o_orderstatus")), "group_idx").groupBy("o_orderstatus").agg(F.sum("sum").alias("sum"))
        one = one.select(F.lit(n).alias("modality"), "o_orderstatus", rounded("sum", 2).alias("sum"))
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {OBS} SELECT o_orderstatus AS sample, c_mktsegment AS cell_type, count(DISTINCT o_orderkey) AS n_cells, round(sum(v), 4) AS total FROM obs LEFT JOIN x ON r = o_orderkey GROUP BY 1, 2")
def communication_inputs_summary(spark, sf_dir):
    def summary(part):
        values = part.entries.groupBy("row").agg(F.sum("value").alias("v"))
        return part.obs.join(values, F.col("_pos") == F.col("row"), "left").groupBy(F.col("o_orderstatus").alias("sample"), F.col("c_mktsegment").alias("cell_type")).agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.sum("v"), 4).alias("total"))

    run = workflows.prepare_communication_inputs(lines(spark, sf_dir), sample_column="o_orderstatus", cell_type_column="c_mktsegment", consumer=summary)
    out = None
    for one in run.results.values():
        out = one if out is None else out.union(one)
    return out


REGIONS = [("low", 0.0, 0.6, 0.0, 0.6), ("high", 0.4, 1.0, 0.4, 1.0), ("band", 0.0, 1.0, 0.3, 0.5)]


@query("WITH p AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1 FROM p), s AS (SELECT vec_id, (a - a0) / (a1 - a0) AS x, (b - b0) / (b1 - b0) AS y FROM p CROSS JOIN m), r(roi, x0, x1, y0, y1) AS (VALUES ('low', 0.0, 0.6, 0.0, 0.6), ('high', 0.4, 1.0, 0.4, 1.0), ('band', 0.0, 1.0, 0.3, 0.5)) SELECT roi, CAST(vec_id AS VARCHAR) AS cell_id FROM s JOIN r ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def roi_rectangles(spark, sf_dir):
    points = research.min_max(vectors(spark, sf_dir).obs, "x", "y")
    return research.rectangle_membership(points, REGIONS).select("roi", "cell_id")


@query(f"WITH {OBS}, t AS (SELECT r, sum(v) AS t FROM x GROUP BY 1) SELECT r AS row, CAST(c AS INTEGER) AS col, round(ln(1 + v / t * 10000), 6) AS value FROM x JOIN t USING (r)")
def normalize_log1p(spark, sf_dir):
    return research.normalized(lines(spark, sf_dir).X).entries().select("row", "col", rounded("value", 6).alias("value"))


@query("SELECT user_id % 4 AS cohort, event_type AS feature, round(sum(value), 4) AS sum FROM events GROUP BY 1, 2".replace("user_id % 4 AS", "CAST(user_id % 4 AS INTEGER) AS"))
def agg_events_cohort(spark, sf_dir):
    got = users(spark, sf_dir).aggregate_many([AggregateTask("t", "cohort")])["t"]
    return got.stats.join(F.broadcast(got.groups.select("group_idx", "cohort")), "group_idx").select("cohort", "feature", rounded("sum").alias("sum"))


@query("SELECT p_name AS symbol, arg_min('p' || p_partkey, p_partkey) AS feature FROM part GROUP BY 1")
def symbol_lookup(spark, sf_dir):
    return research.first_by_symbol(lines(spark, sf_dir).var, "p_name").select("symbol", F.col("_id").alias("feature"))


@query(f"WITH {OBS} SELECT r AS row, sum(v) AS total, count(CASE WHEN v <> 0 THEN 1 END) AS n_features, round(100 * sum(CASE WHEN p_name LIKE 'small%' THEN v ELSE 0 END) / sum(v), 6) AS percent FROM x JOIN part ON c = p_partkey GROUP BY 1")
def quality_control(spark, sf_dir):
    data = lines(spark, sf_dir)
    return research.quality_control(data.X, data.var, "small", "p_name").select("row", "total", "n_features", rounded("percent", 6).alias("percent"))


@query("WITH v AS (SELECT vec_id, embedding AS e FROM embeddings), d AS (SELECT a.vec_id AS row, b.vec_id AS other, list_distance(CAST(a.e AS DOUBLE[]), CAST(b.e AS DOUBLE[])) AS d FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT row, CAST(rank AS INTEGER) AS rank, other, round(d, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY d, other) AS rank FROM d) WHERE rank <= 5")
def knn_exact(spark, sf_dir):
    data = vectors(spark, sf_dir)
    near = analysis.nearest(data.X.rows, 5, data.n_obs)
    return near.select("row", "rank", "other", rounded("distance", 6).alias("distance"))


@query()
def pca_projection(spark, sf_dir):
    data = vectors(spark, sf_dir)
    data.X = Matrix(data.X.rows, "dense", data.n_obs, data.X.n_cols)
    key = analysis.pca(data, 10)
    return data.obsm[key].rows.select("row", F.transform("values", lambda v: F.round(v, 6)).alias("scores"))


def analysed(spark, sf_dir) -> Dataset:
    data = vectors(spark, sf_dir)
    data.X = Matrix(data.X.rows, "dense", data.n_obs, data.X.n_cols)
    analysis.pca(data, 10)
    analysis.neighbors(data, 15)
    return data


@query()
def clusters(spark, sf_dir):
    data = analysed(spark, sf_dir)
    column = analysis.leiden(data)
    return data.obs.select(F.col("_pos").alias("row"), column)


@query()
def umap_layout(spark, sf_dir):
    data = analysed(spark, sf_dir)
    return data.obsm[analysis.umap(data, epochs=50)].rows


@query()
def scope_variance(spark, sf_dir):
    data = vectors(spark, sf_dir)
    return analysis.variance_shares(data.X.entries(), data.obs.select(F.col("_pos").alias("row"), F.col("label").alias("group")), data.X.n_cols)
