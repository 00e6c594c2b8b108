"""Graph learning queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.columns import node_id
from ..operators import graph_ml as N
from ..sources.driver_tables import transfers
from ..sources.ingest import build_graph
from .base import TX, query, with_
from .temporal import round_up, to_places

CUTOFF = "2024-01-20 00:00:00"


def fixed_layer(inputs: int, outputs: int, salt: int):
    """Reproducible weights in [-0.5, 0.5]: a stand-in for trained ones, given by a rule."""
    w = [[((i * 31 + j * 17 + salt) % 101) / 101.0 - 0.5 for j in range(outputs)] for i in range(inputs)]
    return w, [0.01 * j for j in range(outputs)]


def _edges(spark, sf):
    return build_graph(transfers(spark, sf))[1]


def _features(spark, sf):
    return N.node_features(_edges(spark, sf))


@query("n01_snapshot", with_(TX, f"SELECT transaction_id FROM tx WHERE ts <= TIMESTAMP '{CUTOFF}'"))
def n01(spark, sf):
    return N.snapshot_until(transfers(spark, sf), CUTOFF).select("transaction_id")


@query("n02_node_labels", with_(TX, """SELECT 'account:' || a AS node, max(l)::DOUBLE AS label FROM (SELECT sender_account AS a, is_fraud AS l FROM tx UNION ALL SELECT receiver_account, 0 FROM tx) GROUP BY 1
  UNION ALL SELECT DISTINCT 'device:' || device_id, -1.0 FROM tx UNION ALL SELECT DISTINCT 'ip:' || ip_address, -1.0 FROM tx"""))
def n02(spark, sf):
    return N.label_nodes(_features(spark, sf).select("node"), N.node_labels(transfers(spark, sf)))


@query("n03_snapshots", with_(TX, "r AS (SELECT *, row_number() OVER (ORDER BY us) AS i, count(*) OVER () AS n FROM tx)", """SELECT 'train' AS part, count(*) AS transfers, max(us) AS cutoff FROM r WHERE i <= floor(n * 0.7 + 1e-9)
  UNION ALL SELECT 'validation', count(*), max(us) FROM r WHERE i <= floor(n * 0.85 + 1e-9) UNION ALL SELECT 'test', count(*), max(us) FROM r"""))
def n03(spark, sf):
    parts = [d.select(F.lit(k).alias("part"), F.unix_micros("ts").alias("us")) for k, d in N.chronological_snapshots(transfers(spark, sf)).items()]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("transfers"), F.max("us").alias("cutoff"))


NF = """ed AS MATERIALIZED (SELECT 'account:' || sender_account AS s, 'account:' || receiver_account AS d, 't' AS k, amount FROM tx
    UNION ALL SELECT DISTINCT 'account:' || sender_account, 'device:' || device_id, 'd', 0 FROM tx UNION ALL SELECT DISTINCT 'account:' || sender_account, 'ip:' || ip_address, 'i', 0 FROM tx),
nf AS MATERIALIZED (SELECT node, count(*) FILTER (i) AS d_in, count(*) FILTER (NOT i) AS d_out, count(DISTINCT o) FILTER (i AND k = 't') AS u_in, count(DISTINCT o) FILTER (NOT i AND k = 't') AS u_out,
    coalesce(sum(amount) FILTER (i AND k = 't'), 0) AS v_in, coalesce(sum(amount) FILTER (NOT i AND k = 't'), 0) AS v_out, count(*) FILTER (NOT i AND k = 'd') AS devs, count(*) FILTER (NOT i AND k = 'i') AS ips
  FROM (SELECT s AS node, d AS o, k, amount, false AS i FROM ed UNION ALL SELECT d, s, k, amount, true FROM ed) GROUP BY node)"""


@query("n04_account_features", with_(TX, NF, """SELECT node, d_in::DOUBLE AS f0, (d_in + d_out)::DOUBLE AS f2, u_in::DOUBLE AS f3, CASE WHEN v_in > 0 THEN round(log10(v_in + 1), 4) ELSE 0 END AS f5,
  round(u_out / greatest(1, d_out), 4) AS f8, 180.0::DOUBLE AS f9, devs::DOUBLE AS f13, ips::DOUBLE AS f14 FROM nf WHERE node LIKE 'account:%'"""))
def n04(spark, sf):
    f = lambda i: F.get("features", F.lit(i)).alias(f"f{i}")
    return _features(spark, sf).filter("type = 'account'").select("node", *[f(i) for i in (0, 2, 3, 5, 8, 9, 13, 14)])


@query("n05_entity_features", with_(TX, NF, "SELECT node, d_in::DOUBLE AS f0, (node LIKE 'device:%')::INT::DOUBLE AS f13, (node LIKE 'ip:%')::INT::DOUBLE AS f14, 16 AS size FROM nf WHERE node NOT LIKE 'account:%'"))
def n05(spark, sf):
    f = lambda i: F.get("features", F.lit(i)).alias(f"f{i}")
    return _features(spark, sf).filter("type <> 'account'").select("node", f(0), f(13), f(14), F.size("features").alias("size"))


@query("n06_edge_features", with_(TX, NF, "SELECT s AS src, d AS dst, CASE WHEN k = 't' THEN round(log10(amount + 1), 4) ELSE 0 END AS log_amount, (k = 't')::INT::DOUBLE AS t, (k = 'd')::INT::DOUBLE AS d, (k = 'i')::INT::DOUBLE AS i FROM ed"))
def n06(spark, sf):
    a = lambda i, n: F.get("attributes", F.lit(i)).alias(n)
    return N.edge_features(_edges(spark, sf)).select("src", "dst", a(0, "log_amount"), a(1, "t"), a(2, "d"), a(3, "i"))


@query("n07_node_index", with_(TX, NF, "SELECT node, row_number() OVER (ORDER BY node) - 1 AS index FROM nf"))
def n07(spark, sf):
    return N.node_index(_features(spark, sf))


@query("n08_neighbour_means", with_(TX, NF, "SELECT d AS node, round(avg(f.d_in), 4) AS m0, round(avg(f.u_in), 4) AS m3 FROM ed JOIN nf f ON f.node = ed.s GROUP BY 1"))
def n08_means(spark, sf):
    edges = _edges(spark, sf)
    h = N.node_features(edges).select("node", F.col("features").alias("h"))
    m = N._means(h, edges, N.DIM)
    return m.select("node", F.round(F.get("mean", F.lit(0)), 4).alias("m0"), F.round(F.get("mean", F.lit(3)), 4).alias("m3"))


# The sixteen features of a node as rows (node, i, v).
NX = """x0 AS MATERIALIZED (SELECT node, unnest(range(16)) AS i, unnest(CASE
    WHEN node LIKE 'account:%' THEN [d_in, d_out, d_in + d_out, u_in, u_out, CASE WHEN v_in > 0 THEN round(log10(v_in + 1), 4) ELSE 0 END, CASE WHEN v_out > 0 THEN round(log10(v_out + 1), 4) ELSE 0 END,
      round(u_in / greatest(1, d_in), 4), round(u_out / greatest(1, d_out), 4), 180, 1, 0, 0, devs, ips, 0]::DOUBLE[]
    ELSE [d_in, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, (node LIKE 'device:%')::INT, (node LIKE 'ip:%')::INT, 0]::DOUBLE[] END) AS v FROM nf)"""


def layer_sql(name: str, x: str, edges: str, inputs: int, outputs: int, salt: int, unit: bool = True) -> str:
    """One layer over rows (node, i, v): own values and means of the sources, the weights of ``fixed_layer``, ReLU, unit length."""
    length = "greatest(sqrt(sum(v * v) OVER (PARTITION BY node)), 1e-12::DOUBLE)" if unit else "1"
    return f"""{name}_x AS (SELECT node, i, v FROM {x} UNION ALL SELECT e.d, i + {inputs}, avg(v) FROM {edges} e JOIN {x} ON node = e.s GROUP BY 1, 2),
{name}_y AS (SELECT node, j, greatest(0, sum(v * ((i * 31 + j * 17 + {salt}) % 101 / 101.0::DOUBLE - 0.5::DOUBLE)) + 0.01::DOUBLE * j) AS v FROM {name}_x, range({outputs}) t(j) GROUP BY 1, 2),
{name} AS MATERIALIZED (SELECT node, j AS i, v / {length} AS v FROM {name}_y)"""


def _listed(df):
    """One row per node and place of its state."""
    return df.select("node", F.posexplode("h").alias("i", "v")).select("node", "i", round_up("v", 6).alias("v"))


LISTED = f"SELECT node, i::INT AS i, {to_places('v', 6)} AS v FROM "


@query("n08_sage_layer", with_(TX, NF, NX, layer_sql("x1", "x0", "ed", 16, 8, 3), LISTED + "x1"))
def n08(spark, sf):
    edges = _edges(spark, sf)
    h = N.node_features(edges).select("node", F.col("features").alias("h"))
    return _listed(N.sage_layer(h, edges, *fixed_layer(32, 8, 3)))


@query("n09_undirected_features", with_(TX, """u AS (SELECT DISTINCT s, d FROM (SELECT sender_account AS s, receiver_account AS d FROM tx UNION ALL SELECT receiver_account, sender_account FROM tx UNION ALL SELECT sender_account, sender_account FROM tx
  UNION ALL SELECT receiver_account, receiver_account FROM tx)), g AS (SELECT s, count(*) AS n FROM u GROUP BY 1)""", "SELECT 'account:' || s AS node, round(n / (SELECT max(n) FROM g), 6) AS share, round(ln(1 + n), 6) AS log_degree FROM g"))
def n09(spark, sf):
    h = N.undirected_features(_edges(spark, sf))
    return h.select("node", F.round(F.get("h", F.lit(2)), 6).alias("share"), F.round(F.get("h", F.lit(3)), 6).alias("log_degree"))


UX = """u AS MATERIALIZED (SELECT DISTINCT 'account:' || s AS s, 'account:' || d AS d FROM (SELECT sender_account AS s, receiver_account AS d FROM tx UNION ALL SELECT receiver_account, sender_account FROM tx
  UNION ALL SELECT sender_account, sender_account FROM tx UNION ALL SELECT receiver_account, receiver_account FROM tx)),
deg AS (SELECT s AS node, count(*) AS n FROM u GROUP BY 1),
x0 AS MATERIALIZED (SELECT node, unnest(range(4)) AS i, unnest([0, 1, n / (SELECT max(n) FROM deg), ln(1 + n)]::DOUBLE[]) AS v FROM deg)"""


@query("n09_sage_undirected", with_(TX, UX, layer_sql("x1", "x0", "u", 4, 4, 5, unit=False), LISTED + "x1"))
def n09_layer(spark, sf):
    edges = _edges(spark, sf)
    return _listed(N.sage_undirected(N.undirected_features(edges), edges, *fixed_layer(8, 4, 5)))


# Embeddings are kept to six places.
EMBEDDED = ",\n".join([NX, layer_sql("x1", "x0", "ed", 16, 32, 3), layer_sql("x2", "x1", "ed", 32, 16, 7), f"h AS MATERIALIZED ({LISTED} x2)"])


def _embedded(spark, sf):
    edges = _edges(spark, sf)
    return N.embeddings(N.node_features(edges), edges, [fixed_layer(32, 32, 3), fixed_layer(64, 16, 7)])


@query("n10_score_head", with_(TX, NF, EMBEDDED, "p AS (SELECT node, 1 / (1 + exp(0.5::DOUBLE - sum(v * 0.1::DOUBLE * i))) AS p FROM h GROUP BY 1)",
  f"SELECT node, {to_places('p', 6)} AS probability, round_even(p * 100, 0)::INT AS risk, p >= 0.5 AS is_fraud FROM p"))
def n10(spark, sf):
    return N.score_head(_embedded(spark, sf), [0.1 * i for i in range(16)], -0.5).select("node", round_up("probability", 6).alias("probability"), "risk", "is_fraud")


@query("n11_embeddings", with_(TX, NF, EMBEDDED, "SELECT * FROM h"))
def n11(spark, sf):
    return _listed(_embedded(spark, sf))


@query("n12_event_subgraph", with_(TX, NF, """ev AS MATERIALIZED (SELECT transaction_id AS event_id, 'account:' || sender_account AS s0, 'account:' || receiver_account AS d0 FROM tx),
pr2 AS MATERIALIZED (SELECT DISTINCT s0 || '>' || d0 AS event_id, s0, d0 FROM ev), pt AS (SELECT event_id, s0 AS node FROM pr2 UNION SELECT event_id, d0 FROM pr2), nb AS (SELECT s AS a, d AS b FROM ed UNION SELECT d, s FROM ed),
ins AS MATERIALIZED (SELECT event_id, node FROM pt UNION SELECT event_id, b FROM pt JOIN nb ON a = node)""",
  """pairs AS (SELECT s, d, count(*) AS n FROM ed GROUP BY 1, 2), sizes AS (SELECT x.event_id AS pair, sum(n)::BIGINT AS edges FROM pairs JOIN ins x ON x.node = s JOIN ins y ON y.node = d AND y.event_id = x.event_id GROUP BY 1)""",
  "SELECT event_id, edges FROM ev JOIN sizes ON pair = s0 || '>' || d0"))
def n12(spark, sf):
    return N.event_subgraph_counts(_edges(spark, sf), transfers(spark, sf))


@query("n13_fit_head")
def n13(spark, sf):
    h, labels = _embedded(spark, sf), N.node_labels(transfers(spark, sf))
    model = N.fit_head(h, labels, iterations=30)
    out = model.transform(h.select("node", array_to_vector("h").alias("features")))
    return out.select("node", F.round(vector_to_array("probability")[1], 4).alias("probability"))


@query("n14_bce_accuracy", with_(TX, """SELECT round(avg(-(is_fraud * ln(p) + (1 - is_fraud) * ln(1 - p))), 6) AS loss, round(avg(((risk_score / 100 > 0.5)::INT = is_fraud)::INT), 6) AS accuracy
  FROM (SELECT *, least(1 - 1e-7, greatest(1e-7, risk_score / 100)) AS p FROM tx)"""))
def n14(spark, sf):
    tx = transfers(spark, sf).select(F.col("is_fraud").cast("double").alias("label"), (F.col("risk_score") / 100).alias("probability"))
    return N.bce_accuracy(tx).select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


@query("n15_availability", with_(TX, "r AS (SELECT receiver_account AS account, max(risk_score) / 100 AS p FROM tx GROUP BY 1)", """SELECT a.account, round(coalesce(p, 0), 4) AS graph_ml_probability, p IS NOT NULL AS graph_ml_available,
  CASE WHEN p IS NULL THEN 'model_unavailable' ELSE 'available' END AS graph_ml_status FROM (SELECT DISTINCT sender_account AS account FROM tx) a LEFT JOIN r USING (account)"""))
def n15(spark, sf):
    tx = transfers(spark, sf)
    known = tx.groupBy(F.col("receiver_account").alias("account")).agg((F.max("risk_score") / 100).alias("probability"))
    out = N.with_availability(tx.select(F.col("sender_account").alias("account")).distinct(), known)
    return out.select("account", F.round("graph_ml_probability", 4).alias("graph_ml_probability"), "graph_ml_available", "graph_ml_status")
