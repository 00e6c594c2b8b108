"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import node_id, strip_prefix
from ..operators import graph as G
from ..operators.two_hops import near
from ..sources.driver_tables import transfers
from ..sources.ingest import build_graph, link_edges
from .base import TX, query, with_

FOCAL = "focal AS MATERIALIZED (SELECT DISTINCT unnest([sender_account, receiver_account]) AS account FROM tx)"
PAIRS = "pr AS MATERIALIZED (SELECT sender_account AS s, receiver_account AS d, count(*) AS n, sum(amount) AS amount FROM tx GROUP BY 1, 2)"
EDGES = """edges AS MATERIALIZED (SELECT 'account:' || sender_account AS src, 'account:' || receiver_account AS dst, transaction_id AS key, 'TRANSFERRED_FUNDS' AS rel FROM tx
  UNION ALL SELECT DISTINCT 'account:' || sender_account, 'device:' || device_id, 'd', 'USES_DEVICE' FROM tx
  UNION ALL SELECT DISTINCT 'account:' || sender_account, 'ip:' || ip_address, 'i', 'USES_IP' FROM tx),
adj AS MATERIALIZED (SELECT DISTINCT src AS f, dst AS t FROM edges UNION SELECT DISTINCT dst, src FROM edges)"""


def ego_sql(hops: int) -> str:
    parts = ["h0 AS MATERIALIZED (SELECT account, 'account:' || account AS node, 0 AS depth FROM focal)"]
    for h in range(1, hops + 1):
        seen = " UNION ALL ".join(f"SELECT account, node FROM h{i}" for i in range(h))
        parts.append(f"h{h} AS MATERIALIZED (SELECT DISTINCT h.account, t AS node, {h} AS depth FROM h{h - 1} h JOIN adj ON f = h.node WHERE (h.account, t) NOT IN ({seen}))")
    parts.append("ego AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(hops + 1)) + ")")
    return ",\n".join(parts)


FAN = """fm AS MATERIALIZED (SELECT account, in_degree, out_degree, in_degree + out_degree AS total_degree, unique_senders, unique_receivers, round(inbound_volume, 2) AS inbound_volume,
    round(outbound_volume, 2) AS outbound_volume, CASE WHEN in_degree > 0 THEN round(unique_senders / in_degree, 4) ELSE 0 END AS fan_in_ratio,
    CASE WHEN out_degree > 0 THEN round(unique_receivers / out_degree, 4) ELSE 0 END AS fan_out_ratio
  FROM (SELECT account, count(*) FILTER (i) AS in_degree, count(*) FILTER (NOT i) AS out_degree, count(DISTINCT other) FILTER (i) AS unique_senders,
      count(DISTINCT other) FILTER (NOT i) AS unique_receivers, coalesce(sum(amount) FILTER (i), 0) AS inbound_volume, coalesce(sum(amount) FILTER (NOT i), 0) AS outbound_volume
    FROM (SELECT receiver_account AS account, sender_account AS other, amount, true AS i FROM tx UNION ALL SELECT sender_account, receiver_account, amount, false FROM tx) GROUP BY account))"""


def _graph(spark, sf):
    return build_graph(transfers(spark, sf))


def _edges(spark, sf):
    return _graph(spark, sf)[1]


def _everyone(spark, sf):
    return G.accounts_in_large_transfers(transfers(spark, sf), 0.0)


@query("g01_node_ids", with_(TX, """SELECT DISTINCT 'account:' || sender_account AS typed, sender_account AS raw FROM tx UNION SELECT DISTINCT 'ip:' || ip_address, ip_address FROM tx"""))
def g01(spark, sf):
    tx = transfers(spark, sf)
    typed = tx.select(node_id("sender_account", "account").alias("t")).union(tx.select(node_id(node_id("ip_address", "ip"), "ip"))).distinct()
    return typed.select(F.col("t").alias("typed"), strip_prefix("t").alias("raw"))


@query("g02_degrees", with_(TX, FAN, "SELECT account, in_degree, out_degree, total_degree FROM fm"))
def g02(spark, sf):
    return G.degrees(_edges(spark, sf))


@query("g03_counterparties", with_(TX, FAN, "SELECT account, unique_senders, unique_receivers FROM fm"))
def g03(spark, sf):
    return G.counterparties(_edges(spark, sf))


@query("g04_fan_metrics", with_(TX, FAN, "SELECT * FROM fm"))
def g04(spark, sf):
    return G.fan_metrics(_edges(spark, sf))


@query("g05_ego_one_hop_all_accounts", with_(TX, FOCAL, EDGES, ego_sql(1), "SELECT account, node, depth FROM ego"))
def g05_one(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.ego_nodes(nodes, edges, _everyone(spark, sf), 1).select("account", "node", "depth")


@query("g05_ego_two_hops", with_(TX, FOCAL, EDGES, ego_sql(2), "SELECT account, node, depth FROM ego"))
def g05_two(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.ego_nodes(nodes, edges, _everyone(spark, sf), 2).select("account", "node", "depth")


@query("g05_ego_edges", with_(TX, FOCAL, EDGES, ego_sql(1), """SELECT a.account, rel AS relationship, count(*) AS edges FROM edges JOIN ego a ON a.node = src JOIN ego b ON b.node = dst AND b.account = a.account GROUP BY 1, 2"""))
def g05_edges(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.ego_edge_counts(G.ego(nodes, edges, _everyone(spark, sf), 1), edges)


@query("g06_neighbour_counts", with_(TX, FOCAL, EDGES, ego_sql(1), """SELECT account, count(*) FILTER (node LIKE 'account:%' AND node <> 'account:' || account) AS neighbouring_accounts,
  count(*) FILTER (node LIKE 'device:%') AS neighbouring_devices, count(*) FILTER (node LIKE 'ip:%') AS neighbouring_ips,
  count(*) FILTER (node LIKE 'account:%') AS account_nodes, count(*) AS subgraph_nodes FROM ego GROUP BY 1"""))
def g06(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.neighbour_counts(G.ego(nodes, edges, _everyone(spark, sf), 1))


DENSITY = """dens AS MATERIALIZED (SELECT n.account, CASE WHEN n.n >= 2 THEN round(coalesce(p.n, 0) / (n.n * (n.n - 1)), 4) ELSE 0 END AS neighbourhood_density
  FROM (SELECT account, count(*) AS n FROM ego WHERE node LIKE 'account:%' GROUP BY 1) n
  LEFT JOIN (SELECT a.account, count(*) AS n FROM pr JOIN ego a ON a.node = 'account:' || s JOIN ego b ON b.node = 'account:' || d AND b.account = a.account GROUP BY 1) p ON p.account = n.account)"""


@query("g07_density", with_(TX, FOCAL, EDGES, PAIRS, ego_sql(1), DENSITY, "SELECT * FROM dens"))
def g07(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.density(G.ego(nodes, edges, _everyone(spark, sf), 1), edges)


@query("g07_density_two_hops", with_(TX, FOCAL, EDGES, PAIRS, ego_sql(2), DENSITY, "SELECT * FROM dens"))
def g07_two(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.density(near(nodes, edges, _everyone(spark, sf)), edges)


def reach_sql(depth: int) -> str:
    parts = ["ea AS MATERIALIZED (SELECT account, substr(node, 9) AS node FROM ego WHERE node LIKE 'account:%')",
             "st AS MATERIALIZED (SELECT 'down' AS dir, s AS f, d AS t FROM pr UNION ALL SELECT 'up', d, s FROM pr)",
             "b0 AS MATERIALIZED (SELECT account, dir, account AS node, 0 AS depth FROM focal, (SELECT unnest(['down', 'up']) AS dir))"]
    for h in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT account, dir, node FROM b{i}" for i in range(h))
        parts.append(f"""b{h} AS MATERIALIZED (SELECT DISTINCT b.account, b.dir, st.t AS node, {h} AS depth FROM b{h - 1} b JOIN st ON st.f = b.node AND st.dir = b.dir
          JOIN ea ON ea.account = b.account AND ea.node = st.t WHERE (b.account, b.dir, st.t) NOT IN ({seen}))""")
    parts.append("walked AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM b{i}" for i in range(depth + 1)) + ")")
    parts.append("""reach AS MATERIALIZED (SELECT account, count(*) FILTER (dir = 'down' AND depth > 0) AS reachable_accounts, count(*) FILTER (dir = 'up' AND depth > 0) AS upstream_accounts,
      max(depth) FILTER (dir = 'down') AS max_path_length FROM walked GROUP BY 1)""")
    return ",\n".join(parts)


SUMMARY_SQL = """CASE WHEN reachable_accounts > 0 THEN 'Account ' || account || ' can reach ' || reachable_accounts || ' downstream account(s) across a maximum path length of '
  || max_path_length || ' hops.' ELSE 'Account ' || account || ' has no downstream fund transfers.' END"""


@query("g08_reach_one_hop_all_accounts", with_(TX, FOCAL, EDGES, PAIRS, ego_sql(1), reach_sql(5), f"SELECT *, {SUMMARY_SQL} AS path_summary FROM reach"))
def g08(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.reach(G.ego(nodes, edges, _everyone(spark, sf), 1), edges)


@query("g08_reach_two_hops", with_(TX, FOCAL, EDGES, PAIRS, ego_sql(2), reach_sql(5), f"SELECT *, {SUMMARY_SQL} AS path_summary FROM reach"))
def g08_two(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.reach(near(nodes, edges, _everyone(spark, sf)), edges)


CYCLES3 = """cyc AS MATERIALIZED (SELECT s AS account, [s, s] AS path FROM pr WHERE s = d
  UNION ALL SELECT a.s, [a.s, a.d, a.s] FROM pr a JOIN pr b ON b.s = a.d AND b.d = a.s WHERE a.s <> a.d
  UNION ALL SELECT a.s, [a.s, a.d, b.d, a.s] FROM pr a JOIN pr b ON b.s = a.d JOIN pr c ON c.s = b.d AND c.d = a.s WHERE a.s <> a.d AND b.d <> a.d AND b.d <> a.s)"""


@query("g09_cycles_three_hops", with_(TX, PAIRS, CYCLES3, "SELECT account AS start, array_to_string(path, '>') AS path, len(path) - 1 AS length FROM cyc WHERE account = list_min(path)"))
def g09(spark, sf):
    c = G.cycles(_edges(spark, sf), max_depth=3)
    return c.select("start", F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"))


CORE = "core AS MATERIALIZED (SELECT s, d FROM pr WHERE s <> d AND s IN (SELECT d FROM pr) AND d IN (SELECT s FROM pr))"
# Cycles of each account by length: closed walks without those that visit an account twice (the tests compare with a plain search).
RINGS5 = CORE + """,
cw AS MATERIALIZED (SELECT a.s AS a, b.d AS b, count(*) AS w FROM core a JOIN core b ON b.s = a.d GROUP BY 1, 2),
cw3 AS MATERIALIZED (SELECT a, d AS b, sum(w)::BIGINT AS w FROM cw JOIN core ON s = b GROUP BY 1, 2),
cmut AS MATERIALIZED (SELECT x.s AS a, x.d AS b FROM core x JOIN core y ON y.s = x.d AND y.d = x.s),
cr AS MATERIALIZED (SELECT a, w AS r FROM cw WHERE a = b), ct AS MATERIALIZED (SELECT a, w AS t FROM cw3 WHERE a = b),
cmm AS MATERIALIZED (SELECT x.a, y.b, count(*) AS k FROM cmut x JOIN cmut y ON y.a = x.b GROUP BY 1, 2),
cbent AS MATERIALIZED (SELECT cmut.a AS b, core.d AS a, count(*) AS k FROM cmut JOIN core ON core.s = cmut.b GROUP BY 1, 2),
cfour AS (SELECT x.a, sum(x.w * y.w - coalesce(k, 0)) AS n FROM cw x JOIN cw y ON y.a = x.b AND y.b = x.a LEFT JOIN cmm ON cmm.a = x.a AND cmm.b = x.b WHERE x.a <> x.b GROUP BY 1),
cfive AS (SELECT a, sum(n) AS n FROM (
  SELECT cw3.a, cw3.w * cw.w AS n FROM cw3 JOIN cw ON cw.a = cw3.b AND cw.b = cw3.a
  UNION ALL SELECT a, -2 * r * t FROM cr JOIN ct USING (a)
  UNION ALL SELECT core.s, -r * w FROM core JOIN cr ON cr.a = core.d JOIN cw ON cw.a = core.d AND cw.b = core.s
  UNION ALL SELECT cmut.a, -t FROM cmut JOIN ct ON ct.a = cmut.b
  UNION ALL SELECT cw.a, -r * w FROM cw JOIN core ON core.s = cw.b AND core.d = cw.a JOIN cr ON cr.a = cw.b
  UNION ALL SELECT cmut.a, 2 * w FROM cmut JOIN cw ON cw.a = cmut.b AND cw.b = cmut.a
  UNION ALL SELECT cmut.a, 2 * w FROM cmut JOIN cw ON cw.a = cmut.a AND cw.b = cmut.b
  UNION ALL SELECT core.s, k FROM core JOIN cbent ON cbent.b = core.d AND cbent.a = core.s) GROUP BY 1),
rings AS MATERIALIZED (SELECT account, length, n::BIGINT AS n FROM (SELECT s AS account, 1 AS length, 1 AS n FROM pr WHERE s = d UNION ALL SELECT a, 2, r FROM cr UNION ALL SELECT a, 3, t FROM ct
  UNION ALL SELECT a, 4, n FROM cfour UNION ALL SELECT a, 5, n FROM cfive) WHERE n > 0)"""
# Every cycle from its first account, by joining pairs.
FIRSTS4 = CORE + """,
up AS MATERIALIZED (SELECT * FROM core WHERE d > s),
firsts AS (SELECT s AS start, 1 AS length, 1 AS n FROM pr WHERE s = d
  UNION ALL SELECT a.s, 2, count(*) FROM up a JOIN core b ON b.s = a.d AND b.d = a.s GROUP BY 1
  UNION ALL SELECT a.s, 3, count(*) FROM up a JOIN core b ON b.s = a.d AND b.d > a.s JOIN core c ON c.s = b.d AND c.d = a.s GROUP BY 1
  UNION ALL SELECT a.s, 4, count(*) FROM up a JOIN core b ON b.s = a.d AND b.d > a.s JOIN core c ON c.s = b.d AND c.d > a.s AND c.d <> a.d JOIN core d ON d.s = c.d AND d.d = a.s GROUP BY 1)"""


@query("g09_cycles_four_hops", with_(TX, PAIRS, FIRSTS4, "SELECT start, length, n FROM firsts"))
def g09_four(spark, sf):
    """All cycles to four hops of the whole graph are listed, then counted by their first account; five hops (counted below) would be tens of millions of rows."""
    c = G.cycles(_edges(spark, sf), max_depth=4)
    return c.groupBy("start", "length").agg(F.count(F.lit(1)).alias("n"))


@query("g09_cycle_counts", with_(TX, PAIRS, RINGS5, "SELECT account, length, n FROM rings"))
def g09_counts(spark, sf):
    return G.cycle_counts(_edges(spark, sf), max_depth=5)


@query("g10_normalized_cycles", with_(TX, PAIRS, CYCLES3, "SELECT account, array_to_string(path, '>') AS path, len(path) - 1 AS length FROM cyc"))
def g10(spark, sf):
    n = G.normalize_cycles(G.cycles(_edges(spark, sf), max_depth=3))
    return n.select("account", F.array_join("path", ">").alias("path"), F.col("length").cast("long").alias("length"))


@query("g10_cycle_metrics", with_(TX, PAIRS, CYCLES3, RINGS5, """SELECT account, cycle_count, shortest_cycle, cycle_nodes FROM (SELECT account, sum(n)::BIGINT AS cycle_count, min(length)::BIGINT AS shortest_cycle FROM rings GROUP BY 1)
  JOIN (SELECT account, count(DISTINCT node) AS cycle_nodes FROM (SELECT account, unnest(path) AS node FROM cyc) GROUP BY 1) USING (account)"""))
def g10_metrics(spark, sf):
    """Counts and shortest lengths to five hops; the accounts on an account's cycles to three."""
    m = G.cycle_record(_edges(spark, sf), 5, list_depth=3)
    return m.select("account", "cycle_count", F.col("shortest_cycle").cast("long").alias("shortest_cycle"), F.size("cycle_nodes").cast("long").alias("cycle_nodes"))


SEEDS = "seeds AS MATERIALIZED (SELECT transaction_id AS trace_id, sender_account AS u, receiver_account AS v FROM tx)"


def trace_sql(depth: int) -> str:
    """Walks of each (sender, receiver); transfers share those of their two accounts."""
    parts = [SEEDS, "ends AS MATERIALIZED (SELECT DISTINCT u, v FROM seeds)", "t1 AS MATERIALIZED (SELECT u, v, v AS node, 1 AS depth FROM ends)"]
    for h in range(2, depth + 1):
        seen = " UNION ALL ".join(["SELECT u, v, u FROM ends WHERE u <> v"] + [f"SELECT u, v, node FROM t{i}" for i in range(1, h)])
        parts.append(f"t{h} AS MATERIALIZED (SELECT DISTINCT u, v, d AS node, {h} AS depth FROM t{h - 1} JOIN pr ON s = node WHERE (u, v, d) NOT IN ({seen}))")
    parts.append("visited AS MATERIALIZED (SELECT u, v, u AS node, 0 AS depth FROM ends WHERE u <> v UNION ALL " + " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(1, depth + 1)) + ")")
    parts.append("outgoing AS (SELECT sender_account AS node, count(*) AS n FROM tx GROUP BY 1)")
    parts.append(f"followed AS MATERIALIZED (SELECT u, v, node, depth, CASE WHEN depth > 0 AND depth < {depth} THEN coalesce(n, 0) ELSE 0 END AS transfers FROM visited LEFT JOIN outgoing USING (node))")
    return ",\n".join(parts)


@query("g11_trace_accounts", with_(TX, PAIRS, trace_sql(5), "SELECT trace_id, node, depth, transfers FROM seeds JOIN followed USING (u, v)"))
def g11(spark, sf):
    """Traces of all transfers by the accounts they visit; their edges are the transfers followed from each."""
    edges = _edges(spark, sf)
    return G.trace_accounts(G.traces(edges, transfers(spark, sf), 5), edges, 5)


@query("g11_trace_summary", with_(TX, PAIRS, trace_sql(5), """SELECT trace_id, edge_count, accounts, max_depth, 'Funds were traced across ' || edge_count || ' hops involving ' || accounts || ' unique accounts. Layering detected.' AS path_summary
  FROM seeds JOIN (SELECT u, v, sum(transfers)::BIGINT + CASE WHEN u = v THEN 0 ELSE 1 END AS edge_count, count(*) AS accounts, max(depth) AS max_depth FROM followed GROUP BY 1, 2) USING (u, v)"""))
def g11_summary(spark, sf):
    edges = _edges(spark, sf)
    return G.trace_summary(G.traces(edges, transfers(spark, sf), 5), edges, 5)


@query("g12_money_paths", with_(TX, FOCAL, """one AS (SELECT account, [transaction_id] AS keys, receiver_account AS last FROM focal JOIN tx ON sender_account = account),
  two AS (SELECT account, list_append(keys, transaction_id) AS keys, receiver_account FROM one JOIN tx ON sender_account = last WHERE NOT list_contains(keys, transaction_id))""",
  """SELECT account, array_to_string(keys, '>') AS keys, hops, position FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY hops, keys) AS position FROM (
    SELECT account, keys, 1 AS hops FROM one UNION ALL SELECT account, keys, 2 FROM two)) WHERE position <= 25"""))
def g12(spark, sf):
    p = G.money_paths(_edges(spark, sf), _everyone(spark, sf), max_depth=5, limit=25)
    return p.select("account", F.array_join("keys", ">").alias("keys"), "hops", F.col("position").cast("long").alias("position"))


SHARED = """links AS MATERIALIZED (SELECT DISTINCT sender_account AS account, 'device' AS kind, device_id AS entity FROM tx UNION ALL SELECT DISTINCT sender_account, 'ip', ip_address FROM tx),
shared AS MATERIALIZED (SELECT account, kind, entity, count(*) OVER (PARTITION BY kind, entity) AS accounts FROM links)"""


@query("g13_shared_entities", with_(TX, SHARED, "SELECT *, accounts > 1 AS is_shared FROM shared"))
def g13(spark, sf):
    return G.shared_entities(_edges(spark, sf))


@query("g13_shared_counts", with_(TX, SHARED, """SELECT account, count(*) FILTER (kind = 'device' AND accounts > 1) AS shared_device_count, count(*) FILTER (kind = 'ip' AND accounts > 1) AS shared_ip_count,
  coalesce(string_agg(entity, ',' ORDER BY entity) FILTER (kind = 'device'), '') AS devices FROM shared GROUP BY 1"""))
def g13_counts(spark, sf):
    c = G.shared_counts(G.shared_entities(_edges(spark, sf)))
    return c.select("account", "shared_device_count", "shared_ip_count", F.array_join("associated_devices", ",").alias("devices"))


@query("g14_link_devices", with_(TX, "SELECT DISTINCT 'account:' || sender_account AS src, 'device:' || device_id AS dst FROM tx"))
def g14(spark, sf):
    return link_edges(transfers(spark, sf), "device_id", "device").select("src", "dst")


FEATURES = f"""cm AS MATERIALIZED (SELECT account, sum(n)::BIGINT AS cycle_count, min(length)::BIGINT AS shortest_cycle FROM rings GROUP BY 1),
sc AS MATERIALIZED (SELECT account, count(*) FILTER (kind = 'device' AND accounts > 1) AS shared_device_count, count(*) FILTER (kind = 'ip' AND accounts > 1) AS shared_ip_count FROM shared GROUP BY 1),
nc AS MATERIALIZED (SELECT account, count(*) FILTER (node LIKE 'account:%' AND node <> 'account:' || account) AS neighbouring_accounts, count(*) FILTER (node LIKE 'device:%') AS neighbouring_devices,
  count(*) FILTER (node LIKE 'ip:%') AS neighbouring_ips, count(*) AS subgraph_nodes FROM ego GROUP BY 1),
feats AS MATERIALIZED (SELECT account, fm.* EXCLUDE (account), neighbouring_accounts, neighbouring_devices, neighbouring_ips, subgraph_nodes, neighbourhood_density, reachable_accounts, upstream_accounts,
  max_path_length, coalesce(cycle_count, 0) AS cycle_count, coalesce(shortest_cycle, 0) AS shortest_cycle, cycle_count IS NOT NULL AS has_cycle,
  coalesce(shared_device_count, 0) AS shared_device_count, coalesce(shared_ip_count, 0) AS shared_ip_count
  FROM focal JOIN fm USING (account) JOIN nc USING (account) JOIN dens USING (account) JOIN reach USING (account) LEFT JOIN cm USING (account) LEFT JOIN sc USING (account))"""
FEATURE_CTES = (EDGES, PAIRS, ego_sql(2), FAN, DENSITY, reach_sql(5), RINGS5, SHARED, FEATURES)
COLUMNS = ["account", "in_degree", "out_degree", "total_degree", "unique_senders", "unique_receivers", "inbound_volume", "outbound_volume", "fan_in_ratio", "fan_out_ratio",
           "neighbouring_accounts", "neighbouring_devices", "neighbouring_ips", "subgraph_nodes", "neighbourhood_density", "reachable_accounts", "upstream_accounts",
           "max_path_length", "cycle_count", "shortest_cycle", "has_cycle", "shared_device_count", "shared_ip_count"]
SIGNALS = """signals AS MATERIALIZED (SELECT account, 'HIGH_FAN_IN: ' || unique_senders || ' unique senders across ' || in_degree || ' transactions' AS signal FROM feats WHERE unique_senders >= 3 AND fan_in_ratio >= 0.7
  UNION ALL SELECT account, 'HIGH_FAN_OUT: ' || unique_receivers || ' unique receivers across ' || out_degree || ' transactions' FROM feats WHERE unique_receivers >= 3 AND fan_out_ratio >= 0.7
  UNION ALL SELECT account, 'CYCLE_DETECTED: ' || cycle_count || ' circular fund flow loop(s) detected (shortest: ' || shortest_cycle || ' hops)' FROM feats WHERE has_cycle
  UNION ALL SELECT account, 'HIGH_DOWNSTREAM_REACH: ' || reachable_accounts || ' reachable accounts' FROM feats WHERE reachable_accounts >= 3
  UNION ALL SELECT account, CASE kind WHEN 'device' THEN 'SHARED_DEVICE: Device ' ELSE 'SHARED_IP: IP ' END || entity || ' is linked to ' || accounts || ' accounts' FROM shared SEMI JOIN focal USING (account) WHERE accounts > 1)"""


def features(spark, sf, list_depth=0):
    nodes, edges = _graph(spark, sf)
    return G.graph_features(nodes, edges, _everyone(spark, sf), hops=2, max_depth=5, list_depth=list_depth)


def numbers(tx):
    """The graph record of every account without the columns of names."""
    return G.graph_features(*build_graph(tx), G.accounts_in_large_transfers(tx, 0.0), hops=2, max_depth=5, lists=False)


@query("g15_signals", with_(TX, FOCAL, *FEATURE_CTES, SIGNALS, "SELECT account, string_agg(signal, '|' ORDER BY signal) AS signals FROM signals GROUP BY 1"))
def g15(spark, sf):
    return features(spark, sf).filter(F.size("evidence_signals") > 0).select("account", F.array_join("evidence_signals", "|").alias("signals"))


@query("g16_graph_features", with_(TX, FOCAL, *FEATURE_CTES, f"SELECT {', '.join(COLUMNS)} FROM feats"))
def g16(spark, sf):
    return features(spark, sf).withColumn("shortest_cycle", F.col("shortest_cycle").cast("long")).select(*COLUMNS)


@query("g17_event_features", with_(TX, FOCAL, *FEATURE_CTES, f"""SELECT transaction_id, s.in_degree AS sender_in_degree, s.cycle_count AS sender_cycle_count, r.reachable_accounts AS receiver_reachable_accounts,
  r.fan_in_ratio AS receiver_fan_in_ratio FROM tx LEFT JOIN feats s ON s.account = sender_account LEFT JOIN feats r ON r.account = receiver_account"""))
def g17(spark, sf):
    return G.event_graph_features(transfers(spark, sf), features(spark, sf)).select("transaction_id", "sender_in_degree", "sender_cycle_count", "receiver_reachable_accounts", "receiver_fan_in_ratio")


@query("g18_contributing_nodes", with_(TX, FOCAL, EDGES, ego_sql(2), "SELECT account, node FROM ego"))
def g18(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.ego_nodes(nodes, edges, _everyone(spark, sf), 2).select("account", "node")


@query("g18_contributing_transactions", with_(TX, FOCAL, EDGES, ego_sql(1), """SELECT DISTINCT a.account, key AS transaction_id FROM edges JOIN ego a ON a.node = src JOIN ego b ON b.node = dst AND b.account = a.account WHERE rel = 'TRANSFERRED_FUNDS'"""))
def g18_tx(spark, sf):
    nodes, edges = _graph(spark, sf)
    return G.contributing_transactions(G.ego(nodes, edges, _everyone(spark, sf), 1), edges)


@query("g19_unseen_accounts", with_(TX, FOCAL, """SELECT 'ACC-' || s_suppkey AS account, f.account IS NOT NULL AS in_graph, CASE WHEN f.account IS NULL THEN 'Account ACC-' || s_suppkey || ' not found in graph topology.' ELSE 'known' END AS path_summary
  FROM supplier LEFT JOIN focal f ON f.account = 'ACC-' || s_suppkey"""))
def g19(spark, sf):
    from ..sources.driver_tables import table

    nodes, edges = _graph(spark, sf)
    focal = table(spark, sf, "supplier").select(F.concat(F.lit("ACC-"), "s_suppkey").alias("account"))
    f = G.graph_features(nodes, edges, focal, hops=0, max_depth=1)
    return f.select("account", "in_graph", F.when(F.col("in_graph"), "known").otherwise(F.col("path_summary")).alias("path_summary"))
