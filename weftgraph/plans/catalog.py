"""The registered queries over the engine's own operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars
from ..graph import Graph
from ..operators import components, evaluate, fragment, matrix, navigate, pagerank, partition, simulation, traverse
from ..operators.simulation import Pattern
from ..runtime import dealt, materialize, read_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return register


# ---- test graphs -------------------------------------------------------------


def trade(spark: SparkSession, sf_dir: str, kept: bool = False) -> Graph:
    """Parts and suppliers, and every line item between them: back to the supplier what was accepted, from the supplier all else.

    kept: write the edges first, for queries that read them round after round.
    """
    part, supplier = (read_table(spark, sf_dir, t) for t in ("part", "supplier"))
    vertices = part.select((F.col("p_partkey") * 8 + 1).alias("id"), F.col("p_type").alias("label")).unionByName(supplier.select((F.col("s_suppkey") * 8 + 2).alias("id"), F.concat(F.lit("S"), (F.col("s_nationkey") % 5).cast("string")).alias("label")))
    most = read_table(spark, sf_dir, "lineitem").count()  # from the files' footers
    edges = dealt(traded(spark, sf_dir), most, "src", "dst").distinct()
    return Graph(vertices, materialize(edges, "trade") if kept else edges, most)


def traded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst)`` of every line item."""
    p, s, back = F.col("l_partkey") * 8 + 1, F.col("l_suppkey") * 8 + 2, F.col("l_returnflag") == "A"
    return read_table(spark, sf_dir, "lineitem").select(F.when(back, p).otherwise(s).alias("src"), F.when(back, s).otherwise(p).alias("dst"))


TRADE = """v(id, label) AS MATERIALIZED (SELECT p_partkey * 8 + 1, p_type FROM part UNION ALL SELECT s_suppkey * 8 + 2, 'S' || CAST(s_nationkey % 5 AS VARCHAR) FROM supplier),
t(src, dst) AS MATERIALIZED (SELECT CASE WHEN l_returnflag = 'A' THEN l_partkey * 8 + 1 ELSE l_suppkey * 8 + 2 END, CASE WHEN l_returnflag = 'A' THEN l_suppkey * 8 + 2 ELSE l_partkey * 8 + 1 END FROM lineitem),
e(src, dst) AS MATERIALIZED (SELECT DISTINCT src, dst FROM t),
u(src, dst) AS MATERIALIZED (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""
WITH, LOOP = f"WITH {TRADE}", f"WITH RECURSIVE {TRADE}"


def geography(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers, nations and regions, each with an edge to the next."""
    s, n, r = (read_table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    at = lambda c, k: (F.col(c).cast("long") * 4 + k)
    vertices = s.select(at("s_suppkey", 0).alias("id"), F.lit("s").alias("label")).unionByName(n.select(at("n_nationkey", 1).alias("id"), F.lit("n").alias("label"))).unionByName(r.select(at("r_regionkey", 2).alias("id"), F.lit("r").alias("label")))
    edges = s.select(at("s_suppkey", 0).alias("src"), at("s_nationkey", 1).alias("dst")).unionByName(n.select(at("n_nationkey", 1).alias("src"), at("n_regionkey", 2).alias("dst")))
    return Graph(vertices, edges)


TREE = """te(src, dst) AS MATERIALIZED (SELECT s_suppkey * 4, CAST(s_nationkey AS BIGINT) * 4 + 1 FROM supplier UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 4 + 1, CAST(n_regionkey AS BIGINT) * 4 + 2 FROM nation),
tu(src, dst) AS MATERIALIZED (SELECT src, dst FROM te UNION SELECT dst, src FROM te)"""


def suppliers(spark: SparkSession, sf_dir: str, nation: int | None = None) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier")
    s = s if nation is None else s.where(F.col("s_nationkey") == nation)
    return s.select((F.col("s_suppkey") * 8 + 2).alias("id"))


SOME = "sup(id) AS (SELECT s_suppkey * 8 + 2 FROM supplier)"


# ---- scans, predicates, navigation -------------------------------------------


@query(f"{WITH} SELECT id, label FROM v")
def vertex_scan(spark, sf_dir):
    return trade(spark, sf_dir).vertices


@query(f"{WITH} SELECT src, dst FROM e")
def edge_scan(spark, sf_dir):
    return trade(spark, sf_dir).edges


@query(f"{WITH} SELECT id, label FROM v WHERE label = 'PROMO'")
def label_filter(spark, sf_dir):
    return trade(spark, sf_dir).vertices.where("label = 'PROMO'")


@query(f"{WITH} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges")
def graph_counts(spark, sf_dir):
    g = trade(spark, sf_dir)
    both = g.vertices.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(g.edges.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.agg(F.sum("a").alias("n_vertices"), F.sum("b").alias("n_edges"))


@query(f"{WITH}, {SOME} SELECT DISTINCT src AS id, dst AS child FROM e WHERE src IN (SELECT id FROM sup)")
def children(spark, sf_dir):
    return navigate.children(trade(spark, sf_dir), suppliers(spark, sf_dir))


@query(f"{WITH}, {SOME} SELECT DISTINCT dst AS id, src AS parent FROM e WHERE dst IN (SELECT id FROM sup)")
def parents(spark, sf_dir):
    return navigate.parents(trade(spark, sf_dir), suppliers(spark, sf_dir))


@query(f"{WITH}, {SOME} SELECT DISTINCT src AS id, dst AS neighbour FROM u WHERE src IN (SELECT id FROM sup)")
def neighbours(spark, sf_dir):
    return navigate.neighbours(trade(spark, sf_dir), suppliers(spark, sf_dir))


@query(f"{WITH}, o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1) SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM v LEFT JOIN o USING (id) LEFT JOIN i USING (id)")
def degree(spark, sf_dir):
    return navigate.degree(trade(spark, sf_dir))


@query(f"{WITH} SELECT dst AS src, src AS dst, EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src) AS present FROM e")
def contains_edge(spark, sf_dir):
    g = trade(spark, sf_dir)
    return navigate.contains_edge(g, g.reversed().edges)


@query(f"{WITH} SELECT src, dst FROM e WHERE src = 10 AND dst IN (SELECT min(dst) FROM e WHERE src = 10)")
def edges_between(spark, sf_dir):
    g = trade(spark, sf_dir)
    other = g.edges.where("src = 10").agg(F.min("dst")).first()[0]
    return navigate.edges_between(g, 10, other if other is not None else -1)


@query(f"{WITH} SELECT src, dst FROM e UNION ALL SELECT id AS src, id AS dst FROM v WHERE label = 'S1'")
def add_edge(spark, sf_dir):
    g = trade(spark, sf_dir)
    return navigate.add_edges(g, g.vertices.where("label = 'S1'").select(F.col("id").alias("src"), F.col("id").alias("dst"))).edges


@query(f"{WITH} SELECT src, dst FROM e WHERE src % 8 <> 2")
def remove_edge(spark, sf_dir):
    g = trade(spark, sf_dir)
    return navigate.remove_edges(g, g.edges.where("src % 8 = 2")).edges


@query(f"{WITH}, gone AS (SELECT id FROM v WHERE label IN ('S1', 'PROMO')) SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)")
def remove_vertex(spark, sf_dir):
    g = trade(spark, sf_dir)
    return navigate.remove_vertices(g, g.vertices.where("label in ('S1', 'PROMO')")).edges


@query(f"{WITH} SELECT avg(abs(src - dst)) AS compactness FROM e")
def compactness(spark, sf_dir):
    return navigate.compactness(trade(spark, sf_dir).edges)


@query(f"{WITH}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), m AS (SELECT src AS id, CAST(sum(dst - src) AS DOUBLE) / count(*) AS m FROM b GROUP BY 1) SELECT v.id, row_number() OVER (ORDER BY v.id + 0.5::DOUBLE * coalesce(m.m, 0), v.id) - 1 AS place FROM v LEFT JOIN m USING (id)")
def centroid_reorder(spark, sf_dir):
    return navigate.centroid_reorder(trade(spark, sf_dir))


@query(f"{WITH}, p AS (SELECT id, row_number() OVER (ORDER BY id DESC) - 1 AS place FROM v) SELECT a.place AS src, b.place AS dst FROM e JOIN p a ON a.id = e.src JOIN p b ON b.id = e.dst")
def reorder(spark, sf_dir):
    from ..operators.order import numbered

    g = trade(spark, sf_dir)
    return navigate.reorder(g, numbered(g.vertices.select("id"), [F.desc("id")], "place")).edges


# ---- fixpoints ---------------------------------------------------------------

_BFS = "b(id, dist) AS (SELECT CAST(10 AS BIGINT), 0 UNION SELECT u.dst, b.dist + 1 FROM b JOIN u ON u.src = b.id WHERE b.dist < {n}), l AS (SELECT id, min(dist) AS dist FROM b GROUP BY 1)"


def one(spark: SparkSession, id: int) -> DataFrame:
    return spark.createDataFrame([(id,)], "id long")


@query(f"{LOOP}, {_BFS.format(n=12)} SELECT CAST(10 AS BIGINT) AS source, id, dist FROM l")
def bfs_levels(spark, sf_dir):
    return traverse.bfs(materialize(trade(spark, sf_dir).undirected(), "trade"), one(spark, 10))


@query(f"{LOOP}, {_BFS.format(n=2)} SELECT v.id, v.label FROM v JOIN l USING (id)")
def ego_vertices(spark, sf_dir):
    return traverse.ego(trade(spark, sf_dir, True), 10, 2).vertices


@query(f"{LOOP}, {_BFS.format(n=2)} SELECT src, dst FROM e WHERE src IN (SELECT id FROM l WHERE dist < 2) OR dst IN (SELECT id FROM l WHERE dist < 2)")
def ego_edges(spark, sf_dir):
    return traverse.ego(trade(spark, sf_dir, True), 10, 2).edges


_ALL = f"WITH RECURSIVE {TREE}, w(s, id, dist) AS (SELECT DISTINCT src, src, 0 FROM tu UNION SELECT w.s, tu.dst, w.dist + 1 FROM w JOIN tu ON tu.src = w.id WHERE w.dist < 5), l AS (SELECT s, id, min(dist) AS dist FROM w GROUP BY 1, 2), x AS (SELECT s AS id, CAST(max(dist) AS BIGINT) AS eccentricity FROM l GROUP BY 1)"


@query(f"{_ALL} SELECT id, eccentricity FROM x UNION ALL SELECT r_regionkey * 4 + 2, 0 FROM region WHERE r_regionkey NOT IN (SELECT n_regionkey FROM nation) UNION ALL SELECT n_nationkey * 4 + 1, 0 FROM nation WHERE false")
def eccentricity(spark, sf_dir):
    g = geography(spark, sf_dir)
    return traverse.eccentricity(g, g.vertices.select("id"))


@query(f"{_ALL} SELECT max(eccentricity) AS diameter FROM x")
def diameter(spark, sf_dir):
    return traverse.diameter(geography(spark, sf_dir))


@query(f"WITH RECURSIVE {TREE}, w(s, id) AS (SELECT src, dst FROM te UNION SELECT w.s, te.dst FROM w JOIN te ON te.src = w.id) SELECT count(*) > 0 AS has_cycles FROM w WHERE s = id")
def has_cycles(spark, sf_dir):
    return traverse.has_cycles(geography(spark, sf_dir))


@query(f"{WITH} SELECT (SELECT count(*) FROM e JOIN e f ON f.src = e.dst AND f.dst = e.src) + (SELECT count(*) FROM (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON b.src = a.dst) x JOIN (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON b.src = a.dst) y ON y.src = x.dst AND y.dst = x.src) > 0 AS has_cycles")
def has_cycles_trade(spark, sf_dir):
    return traverse.has_cycles(trade(spark, sf_dir, True))


def visits(spark: SparkSession, sf_dir: str) -> Graph:
    """Events, and an edge from each to the same user's next one."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    following = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = e.select(F.col("event_id").alias("src"), following.alias("dst")).where("dst is not null")
    return Graph(e.select(F.col("event_id").alias("id"), F.col("event_type").alias("label")), edges)


VISITS = "ev AS (SELECT event_id, user_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM events), ee(src, dst) AS MATERIALIZED (SELECT event_id, nx FROM ev WHERE nx IS NOT NULL)"


@query(f"WITH RECURSIVE {VISITS}, w(s, id) AS (SELECT src, dst FROM ee UNION SELECT w.s, ee.dst FROM w JOIN ee ON ee.src = w.id) SELECT count(*) > 0 AS has_cycles FROM w WHERE s = id")
def has_cycles_events(spark, sf_dir):
    return traverse.has_cycles(visits(spark, sf_dir))


@query(f"WITH {VISITS} SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS component FROM ev QUALIFY count(*) OVER (PARTITION BY user_id) > 1")
def components_events(spark, sf_dir):
    return components.connected_components(visits(spark, sf_dir).edges)


@query(f"WITH RECURSIVE {TREE}, w(s, id) AS (SELECT src, src FROM tu UNION SELECT w.s, tu.dst FROM w JOIN tu ON tu.src = w.id) SELECT s AS id, min(id) AS component FROM w GROUP BY 1")
def connected_components(spark, sf_dir):
    return components.connected_components(geography(spark, sf_dir).edges)


@query(f"""{LOOP}, we AS (SELECT src, dst, CAST(1 + (src + dst) % 7 AS DOUBLE) AS w FROM u),
d(it, id, dist) AS (SELECT 0, CAST(10 AS BIGINT), CAST(0 AS DOUBLE) UNION ALL SELECT it + 1, id, min(dist) FROM (SELECT it, id, dist FROM d WHERE it < 25 UNION ALL SELECT d.it, we.dst, d.dist + we.w FROM d JOIN we ON we.src = d.id WHERE d.it < 25) GROUP BY it, id)
SELECT id, dist FROM d WHERE it = 25""")
def sssp(spark, sf_dir):
    weighted = trade(spark, sf_dir).undirected().withColumn("w", (1 + (F.col("src") + F.col("dst")) % 7).cast("double"))
    return traverse.sssp(materialize(weighted, "trade"), 10)


PATTERNS = {
    "dag": Pattern(((0, "S0"), (1, "PROMO"), (2, "SMALL"), (3, "S3")), ((0, 1), (0, 2), (1, 3))),
    "cyc2": Pattern(((0, "LARGE"), (1, "S4")), ((0, 1), (1, 0))),
    "cyc4": Pattern(((0, "PROMO"), (1, "S1"), (2, "ECONOMY"), (3, "S2")), ((0, 1), (0, 3), (1, 2), (2, 3), (3, 0))),
}


def _simulated(p: Pattern) -> str:
    nodes, edges = ", ".join(f"({u}, '{x}')" for u, x in p.nodes), ", ".join(map(str, p.edges))
    return f"""{LOOP}, q(u, label) AS (VALUES {nodes}), qe(src, dst) AS (VALUES {edges}),
r(it, u, v) AS (SELECT 0, CAST(q.u AS BIGINT), v.id FROM q JOIN v USING (label) UNION ALL SELECT r.it + 1, r.u, r.v FROM r WHERE r.it < 30 AND NOT EXISTS (
  SELECT 1 FROM qe WHERE qe.src = r.u AND (qe.dst, r.v) NOT IN (SELECT r2.u, e.src FROM e JOIN r r2 ON r2.v = e.dst)))
SELECT u, v FROM r WHERE it = 30"""


for _name, _pattern in PATTERNS.items():
    query(_simulated(_pattern), f"simulation_{_name}")(lambda spark, sf_dir, p=_pattern: simulation.simulation(trade(spark, sf_dir, True), p))


@query(f"SELECT u, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS matches FROM ({_simulated(PATTERNS['dag'])}) GROUP BY 1")
def simulation_assembled(spark, sf_dir):
    found = simulation.assembled(simulation.simulation(trade(spark, sf_dir, True), PATTERNS["dag"]))
    return found.select("u", F.array_join("matches", ",").alias("matches"))


def _messages(n: int) -> str:
    steps = [f"{WITH}, o AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM e GROUP BY 1), r0 AS MATERIALIZED (SELECT v.id, CAST(0.5 AS DOUBLE) AS rank, true AS active, o.d FROM v LEFT JOIN o USING (id))"]
    for k in range(n):
        steps.append(f"m{k} AS MATERIALIZED (SELECT e.dst AS id, sum(r.rank / r.d) AS m FROM r{k} r JOIN e ON e.src = r.id WHERE r.active GROUP BY 1), r{k + 1} AS MATERIALIZED (SELECT r.id, CASE WHEN m.m IS NULL THEN r.rank ELSE coalesce(CAST(0.15 AS DOUBLE) / r.d, 0) + CAST(0.85 AS DOUBLE) * m.m END AS rank, m.m IS NOT NULL AS active, r.d FROM r{k} r LEFT JOIN m{k} m USING (id))")
    return ", ".join(steps) + f" SELECT id, round(rank, 6) AS rank FROM r{n}"


def _walk(n: int, start: str) -> str:
    steps = [f"{WITH}, o AS MATERIALIZED (SELECT src AS id, count(*) AS d FROM e GROUP BY 1), r0 AS MATERIALIZED (SELECT v.id, {start} AS r, {start} AS rank, o.d FROM v LEFT JOIN o USING (id))"]
    for k in range(n):
        steps.append(f"m{k} AS MATERIALIZED (SELECT e.dst AS id, sum(r.rank / r.d) AS m FROM r{k} r JOIN e ON e.src = r.id GROUP BY 1), r{k + 1} AS MATERIALIZED (SELECT r.id, r.r, CAST(0.8 AS DOUBLE) * ((SELECT coalesce(sum(rank), 0) FROM r{k} WHERE d IS NULL) * r.r + coalesce(m.m, 0)) + CAST(0.2 AS DOUBLE) * r.r AS rank, r.d FROM r{k} r LEFT JOIN m{k} m USING (id))")
    return ", ".join(steps) + f" SELECT id, round(rank, 8) AS rank FROM r{n}"


@query(_messages(9))
def pagerank_message_driven(spark, sf_dir):
    return pagerank.message_driven(trade(spark, sf_dir, True)).select("id", F.round("rank", 6).alias("rank"))


@query(_walk(10, "CAST(1 AS DOUBLE) / (SELECT count(*) FROM v)"))
def pagerank_rw(spark, sf_dir):
    return pagerank.random_walk(trade(spark, sf_dir, True)).select("id", F.round("rank", 8).alias("rank"))


@query(_walk(10, "CASE WHEN v.id = 10 THEN CAST(1 AS DOUBLE) ELSE 0 END"))
def pagerank_personalized(spark, sf_dir):
    return pagerank.personalized(trade(spark, sf_dir, True), 10).select("id", F.round("rank", 8).alias("rank"))


# ---- fragments ---------------------------------------------------------------

OWNED = f"{WITH}, w AS (SELECT id, CAST(id % 3 AS INTEGER) AS pid FROM v), x AS MATERIALIZED (SELECT e.src, e.dst, a.pid AS p, b.pid AS q FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst), y AS MATERIALIZED (SELECT u.src, u.dst, a.pid AS p, b.pid AS q FROM u JOIN w a ON a.id = u.src JOIN w b ON b.id = u.dst WHERE u.src <> u.dst)"


def owned(spark: SparkSession, sf_dir: str) -> tuple[Graph, DataFrame]:
    g = trade(spark, sf_dir)
    return g, fragment.hash_owner(g, 3)


@query(f"{OWNED} SELECT id, pid FROM w")
def hash_partition(spark, sf_dir):
    return owned(spark, sf_dir)[1]


@query(f"{WITH} SELECT id, CAST(ntile(3) OVER (ORDER BY id) - 1 AS INTEGER) AS pid FROM v")
def range_partition(spark, sf_dir):
    return fragment.range_owner(trade(spark, sf_dir), 3)


@query(f"{OWNED} SELECT p AS pid, src, dst, CASE WHEN p = q THEN 0 ELSE 1 END AS tag FROM x UNION ALL SELECT q, src, dst, 2 FROM x WHERE p <> q")
def fragment_edges(spark, sf_dir):
    return fragment.fragment_edges(*owned(spark, sf_dir))


@query(f"{OWNED} SELECT DISTINCT q AS pid, src AS id FROM x WHERE p <> q")
def border_in(spark, sf_dir):
    return fragment.border(*owned(spark, sf_dir)).where("kind = 'in'").select("pid", "id")


@query(f"{OWNED} SELECT DISTINCT p AS pid, dst AS id FROM x WHERE p <> q")
def border_out(spark, sf_dir):
    return fragment.border(*owned(spark, sf_dir)).where("kind = 'out'").select("pid", "id")


@query(f"{OWNED} SELECT src AS id, p AS pid FROM x WHERE p <> q UNION SELECT dst, q FROM x WHERE p <> q")
def virtual_vertex_map(spark, sf_dir):
    return fragment.virtual_vertices(*owned(spark, sf_dir))


@query(f"{OWNED}, b AS (SELECT DISTINCT p AS pid, dst AS id, 'out' AS kind FROM x WHERE p <> q UNION SELECT DISTINCT q, src, 'in' FROM x WHERE p <> q), f AS (SELECT p AS pid FROM x UNION ALL SELECT q FROM x WHERE p <> q) SELECT pid, (SELECT count(*) FROM (SELECT id FROM w WHERE w.pid = z.pid UNION SELECT id FROM b WHERE b.pid = z.pid)) AS n_vertices, (SELECT count(*) FROM f WHERE f.pid = z.pid) AS n_edges, (SELECT count(*) FROM b WHERE b.pid = z.pid AND kind = 'out') AS n_out, (SELECT count(*) FROM b WHERE b.pid = z.pid AND kind = 'in') AS n_in FROM (SELECT DISTINCT pid FROM w) z")
def partition_summary(spark, sf_dir):
    return fragment.summary(*owned(spark, sf_dir))


@query(f"{OWNED} SELECT count(*) AS edge_cut FROM y WHERE p <> q AND src < dst")
def edge_cut(spark, sf_dir):
    return fragment.edge_cut(*owned(spark, sf_dir))


@query(f"{OWNED} SELECT count(*) AS comm_volume FROM (SELECT DISTINCT src, q FROM y WHERE p <> q)")
def comm_volume(spark, sf_dir):
    return fragment.comm_volume(*owned(spark, sf_dir))


@query(f"{OWNED} SELECT max(n) AS max_cut FROM (SELECT p, count(*) AS n FROM y WHERE p <> q GROUP BY 1)")
def max_cut(spark, sf_dir):
    return fragment.max_cut(*owned(spark, sf_dir))


@query(f"{OWNED} SELECT CAST(max(n) * 3 AS DOUBLE) / sum(n) AS balance FROM (SELECT pid, count(*) AS n FROM w GROUP BY 1)")
def balance(spark, sf_dir):
    return fragment.balance(owned(spark, sf_dir)[1], 3)


@query(f"{OWNED} SELECT pid, (SELECT count(DISTINCT q) FROM y WHERE y.p = z.pid AND p <> q) AS n_adjacent FROM (SELECT DISTINCT pid FROM w) z")
def subdomain_degree(spark, sf_dir):
    return fragment.subdomain_degree(*owned(spark, sf_dir))


@query(f"WITH RECURSIVE {TREE}, i AS MATERIALIZED (SELECT src, dst FROM tu WHERE src % 4 // 2 = dst % 4 // 2), t AS (SELECT src AS id FROM tu UNION SELECT r_regionkey * 4 + 2 FROM region), c(s, id) AS (SELECT id, id FROM t UNION SELECT c.s, i.dst FROM c JOIN i ON i.src = c.id) SELECT pid, count(*) AS n_components FROM (SELECT DISTINCT CAST(s % 4 // 2 AS INTEGER) AS pid, m FROM (SELECT s, min(id) AS m FROM c GROUP BY 1)) GROUP BY 1")
def partition_components(spark, sf_dir):
    g = geography(spark, sf_dir)
    return fragment.partition_components(g, g.vertices.select("id", F.floor(F.col("id") % 4 / 2).cast("int").alias("pid")))


@query(f"{WITH} SELECT (SELECT count(*) FROM e WHERE src = dst) AS self_loops, (SELECT count(*) FROM e WHERE (dst, src) NOT IN (SELECT src, dst FROM e)) AS asymmetric, (SELECT count(*) FROM t) - (SELECT count(*) FROM e) AS duplicates")
def graph_check(spark, sf_dir):
    return fragment.graph_check(Graph(trade(spark, sf_dir).vertices, traded(spark, sf_dir)))


@query(f"{WITH}, c AS (SELECT src, dst FROM u UNION SELECT id, id FROM v), k AS (SELECT src, list_sort(list(dst)) AS l FROM c GROUP BY 1) SELECT min(src) AS representative, count(*) AS size FROM k GROUP BY l")
def graph_compress(spark, sf_dir):
    return fragment.graph_compress(trade(spark, sf_dir))


def mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as elements, parts as nodes."""
    return read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("element"), F.col("l_partkey").alias("node"))


MESH = "m AS MATERIALIZED (SELECT DISTINCT l_orderkey AS element, l_partkey AS node FROM lineitem)"


@query(f"WITH {MESH} SELECT DISTINCT a.element AS src, b.element AS dst FROM m a JOIN m b ON a.node = b.node AND a.element < b.element")
def mesh_dual(spark, sf_dir):
    return fragment.mesh_dual(mesh(spark, sf_dir))


@query(f"WITH {MESH} SELECT DISTINCT a.node AS src, b.node AS dst FROM m a JOIN m b ON a.element = b.element AND a.node < b.node")
def mesh_nodal(spark, sf_dir):
    return fragment.mesh_nodal(mesh(spark, sf_dir))


@query()
def multilevel_partition(spark, sf_dir):
    return partition.multilevel(trade(spark, sf_dir, True), 4)


# ---- matrices, itemsets, rankings, scalars ------------------------------------


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by part types: quantities."""
    items, orders, part = (read_table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    code = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(TYPES) for x in (t, i)]), F.col("p_type")).cast("long")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("o_custkey").alias("row"), code.alias("col")).agg(F.sum("l_quantity").alias("val"))


TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
CELLS = "WITH c AS MATERIALIZED (SELECT o_custkey AS \"row\", CAST(list_position([" + ", ".join(f"'{t}'" for t in TYPES) + "], p_type) - 1 AS BIGINT) AS col, sum(l_quantity) AS val FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f'{CELLS} SELECT "row", col, val FROM c WHERE "row" BETWEEN 100 AND 199')
def matrix_submatrix(spark, sf_dir):
    return matrix.submatrix(cells(spark, sf_dir), 100, 100)


@query(f'{CELLS} SELECT "row", col, val FROM c WHERE "row" IN (SELECT "row" FROM c GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5)')
def matrix_prune(spark, sf_dir):
    return matrix.prune(cells(spark, sf_dir), 2, 5, "row")


@query(f'{CELLS}, s AS (SELECT *, coalesce(sum(val * val) OVER (PARTITION BY "row" ORDER BY val DESC, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(val * val) OVER (PARTITION BY "row") AS t FROM c) SELECT "row", col, val FROM s WHERE sqrt(b) <= CAST(0.7 AS DOUBLE) * sqrt(t)')
def matrix_lowfilter(spark, sf_dir):
    return matrix.low_filter(cells(spark, sf_dir), 0.7)


@query(f'{CELLS}, s AS (SELECT *, row_number() OVER (PARTITION BY "row" ORDER BY val DESC, col) AS r FROM c) SELECT "row", col, val FROM s WHERE r <= 2 OR val >= 200')
def matrix_topkplus(spark, sf_dir):
    return matrix.topk_plus(cells(spark, sf_dir), 2, 200.0)


@query(f'{CELLS}, s AS (SELECT *, count(*) OVER (PARTITION BY "row") AS n FROM c) SELECT "row", col, val FROM s WHERE val > CAST(600 AS DOUBLE) / n')
def matrix_zscore(spark, sf_dir):
    return matrix.zscore_filter(cells(spark, sf_dir), 600.0)


@query(f'{CELLS}, p AS (SELECT col, row_number() OVER (ORDER BY count(*) DESC, col) - 1 AS place FROM c GROUP BY 1) SELECT "row", place AS col, val FROM c JOIN p USING (col)')
def matrix_compact(spark, sf_dir):
    return matrix.compact_columns(cells(spark, sf_dir))


@query(f'{CELLS} SELECT "row", col, round(val / sqrt(sum(val * val) OVER (PARTITION BY "row")), 8) AS val FROM c')
def matrix_normalize(spark, sf_dir):
    return matrix.normalize(cells(spark, sf_dir)).withColumn("val", F.round("val", 8))


SCALES = {
    "maxtf": 'CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * val / max(abs(val)) OVER (PARTITION BY "row")',
    "maxtf2": 'CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * val / max(abs(val)) OVER (PARTITION BY "row")',
    "log": "CASE WHEN val = 0 THEN val ELSE sign(val) * (1 + log2(abs(val))) END",
    "sqrt": "CASE WHEN val = 0 THEN val ELSE CAST(0.1 AS DOUBLE) + sign(val) * sqrt(abs(val)) END",
    "pow25": "CASE WHEN val = 0 THEN val ELSE CAST(0.1 AS DOUBLE) + sign(val) * pow(abs(val), 0.25) END",
    "pow65": "CASE WHEN val = 0 THEN val ELSE CAST(0.1 AS DOUBLE) + sign(val) * pow(abs(val), 0.65) END",
    "pow75": "CASE WHEN val = 0 THEN val ELSE CAST(0.1 AS DOUBLE) + sign(val) * pow(abs(val), 0.75) END",
    "pow85": "CASE WHEN val = 0 THEN val ELSE CAST(0.1 AS DOUBLE) + sign(val) * pow(abs(val), 0.85) END",
    "idf": 'val * ln(CAST((SELECT count(DISTINCT "row") FROM c) AS DOUBLE) / count(*) OVER (PARTITION BY col))',
    "idf2": "val * ln((CAST((SELECT count(DISTINCT \"row\") FROM c) AS DOUBLE) + 2.0 * b) / (b + count(*) OVER (PARTITION BY col)))",
}
for _how, _expr in SCALES.items():
    _from = "c" if _how != "idf2" else "c CROSS JOIN (SELECT greatest(10, CAST(floor(CAST(0.5 AS DOUBLE) * count(*) / count(DISTINCT col)) AS BIGINT)) AS b FROM c)"
    query(f'{CELLS} SELECT "row", col, round({_expr}, 7) AS val FROM {_from}', f"matrix_{_how}")(lambda spark, sf_dir, how=_how: matrix.scale(cells(spark, sf_dir), how).withColumn("val", F.round("val", 7)))


@query(f'{CELLS} SELECT "row", sum(val) AS total, sum(val * val) AS squared_norm FROM c GROUP BY 1')
def matrix_sums(spark, sf_dir):
    return matrix.sums(cells(spark, sf_dir))


_PARTS = {"cos": ("val * val", "a.val * b.val", "s / sqrt(n * t)"), "jac": ("val * val", "a.val * b.val", "s / (n + t - s)"), "min": ("abs(val)", "least(a.val, b.val)", "s / (n + t - s)"), "amin": ("abs(val)", "least(a.val, b.val)", "s / t")}


def _similar(measure: str) -> str:
    size, part, sim = _PARTS[measure]
    return f'{CELLS}, q AS (SELECT col, val FROM c WHERE "row" = (SELECT min("row") FROM c)), n AS (SELECT "row", sum({size}) AS n FROM c GROUP BY 1), z AS (SELECT a."row", sum({part}) AS s FROM c a JOIN q b USING (col) GROUP BY 1), y AS (SELECT "row", round({sim}, 8) AS sim FROM z JOIN n USING ("row") CROSS JOIN (SELECT sum({size}) AS t FROM q)) SELECT "row", sim FROM y WHERE sim >= 0.5'


for _measure in matrix.MEASURES:

    def _run(spark, sf_dir, measure=_measure):
        m = materialize(cells(spark, sf_dir), "cells")
        first = m.agg(F.min("row")).first()[0]
        found = matrix.similar_rows(m, m.where(F.col("row") == first).select("col", "val"), measure)
        return found.withColumn("sim", F.round("sim", 8)).where("sim >= 0.5")

    query(_similar(_measure), f"similar_rows_{_measure}")(_run)


@query(f'{CELLS}, p AS (SELECT DISTINCT "row", "row" + 1 AS row2 FROM c WHERE "row" + 1 IN (SELECT "row" FROM c)), n AS (SELECT "row", sum(val * val) AS n FROM c GROUP BY 1) SELECT p."row", p.row2, round(coalesce((SELECT sum(a.val * b.val) FROM c a JOIN c b USING (col) WHERE a."row" = p."row" AND b."row" = p.row2), 0) / sqrt(n.n * m.n), 8) AS sim FROM p JOIN n ON n."row" = p."row" JOIN n m ON m."row" = p.row2')
def row_similarity(spark, sf_dir):
    m = materialize(cells(spark, sf_dir), "cells")
    rows = m.select("row").distinct()
    pairs = rows.withColumn("row2", F.col("row") + 1).join(rows.select(F.col("row").alias("row2")), "row2", "left_semi").select("row", "row2")
    return matrix.row_similarity(m, pairs).withColumn("sim", F.round("sim", 8))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, part = read_table(spark, sf_dir, "lineitem"), read_table(spark, sf_dir, "part")
    return items.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("basket"), F.col("p_type").alias("item")).distinct()


BASKETS = "WITH b AS MATERIALIZED (SELECT DISTINCT l_orderkey AS basket, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"
for _n in (1, 2, 3):
    _joins = "b b0" + "".join(f" JOIN b b{i} ON b{i}.basket = b0.basket AND b{i}.item > b{i - 1}.item" for i in range(1, _n))
    query(f"{BASKETS} SELECT {' || \',\' || '.join(f'b{i}.item' for i in range(_n))} AS items, count(*) AS support FROM {_joins} GROUP BY 1 HAVING count(*) >= 10", f"itemsets_{_n}")(
        lambda spark, sf_dir, n=_n: matrix.itemsets(baskets(spark, sf_dir), 10, n).select(F.array_join("items", ",").alias("items"), "support")
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select(F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("positive"))


SCORED = "WITH s AS MATERIALIZED (SELECT CAST(n_chars AS DOUBLE) AS score, quality = 1 AS y FROM labels JOIN documents USING (doc_id)), g AS (SELECT score, count(*) FILTER (WHERE y) AS p, count(*) FILTER (WHERE NOT y) AS n FROM s GROUP BY 1), r AS MATERIALIZED (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS fp, sum(p) OVER () AS np, sum(n) OVER () AS nn FROM g WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"{SCORED} SELECT round(CAST(greatest(max(tp + nn - fp), max(nn)) AS DOUBLE) / max(np + nn), 10) AS max_accuracy FROM r")
def max_accuracy(spark, sf_dir):
    return evaluate.max_accuracy(scored(spark, sf_dir)).select(F.round("max_accuracy", 10).alias("max_accuracy"))


@query(f"{SCORED} SELECT round(CAST(sum(n * (tp - CAST(p AS DOUBLE) / 2)) AS DOUBLE) / max(np * nn), 10) AS roc_auc FROM r")
def roc_auc(spark, sf_dir):
    return evaluate.roc_auc(scored(spark, sf_dir)).select(F.round("roc_auc", 10).alias("roc_auc"))


@query(f"{SCORED} SELECT round(CAST(max(fp - n) AS DOUBLE) / max(nn), 10) AS median_rfp FROM r WHERE tp >= (np + 1) // 2 AND tp - p < (np + 1) // 2")
def median_rfp(spark, sf_dir):
    return evaluate.median_rfp(scored(spark, sf_dir)).select(F.round("median_rfp", 10).alias("median_rfp"))


@query("SELECT avg(CAST(n_chars AS DOUBLE)) AS mean, round(stddev_pop(CAST(n_chars AS DOUBLE)), 6) AS deviation FROM documents")
def mean_deviation(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents")
    return d.agg(F.avg(F.col("n_chars").cast("double")).alias("mean"), F.round(F.stddev_pop(F.col("n_chars").cast("double")), 6).alias("deviation"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(v, lambda y: y * y)), 6) AS dot, round(sqrt(list_sum(list_transform(v, lambda y: y * y))), 6) AS norm, CAST(list_position(v, list_max(v)) - 1 AS BIGINT) AS argmax FROM x")
def vec_dot_norm(spark, sf_dir):
    v = F.col("embedding")
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.dot(v, v), 6).alias("dot"), F.round(scalars.norm2(v), 6).alias("norm"), scalars.argmax(v).alias("argmax"))


@query("SELECT c_custkey, regexp_replace(c_name, '([A-Za-z]+)#0*([0-9]+)', '\\2-\\1', 'g') AS name FROM customer")
def regex_replace(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", scalars.replace_regex(F.col("c_name"), "([A-Za-z]+)#0*([0-9]+)", "$2-$1").alias("name"))


@query("SELECT p_partkey, CAST(len(list_filter(string_split_regex(p_name, '[ #-]+'), lambda x: x <> '')) AS INTEGER) AS n_tokens FROM part")
def tokenize(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", F.size(scalars.tokens(F.col("p_name"), " #-")).alias("n_tokens"))


@query("SELECT event_id, strftime(ts, '%m/%d/%Y %H:%M:%S') AS at FROM events")
def time_format(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", scalars.time_text(F.col("ts")).alias("at"))


@query("SELECT r_regionkey, base64(encode(r_name)) AS coded, r_name AS decoded FROM region")
def base64_round_trip(spark, sf_dir):
    coded = F.base64(F.col("r_name").cast("binary"))
    return read_table(spark, sf_dir, "region").select("r_regionkey", coded.alias("coded"), F.unbase64(coded).cast("string").alias("decoded"))


def queries() -> dict[str, Query]:
    from . import further  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import further  # noqa: F401

    return dict(_SQL)
