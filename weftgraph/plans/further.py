"""More registered queries: membership, extraction, edits, programs, sorted orders, column-wise matrices, strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import evaluate, fragment, matrix, navigate, order, pagerank, program, traverse
from ..runtime import materialize, read_table
from .catalog import BASKETS, CELLS, LOOP, MESH, OWNED, SCORED, TYPES, VISITS, WITH, _walk, baskets, cells, mesh, owned, query, scored, trade, traded, visits

# ---- membership, edits, extraction --------------------------------------------


@query(f"{WITH} SELECT id + 8 AS id, id + 8 IN (SELECT id FROM v) AS present FROM v")
def contains_vertex(spark, sf_dir):
    g = trade(spark, sf_dir)
    return navigate.contains_vertices(g, g.vertices.select((F.col("id") + 8).alias("id")))


@query(f"{WITH} SELECT id, label FROM v WHERE id = 10")
def get_vertex(spark, sf_dir):
    return navigate.vertex(trade(spark, sf_dir), 10)


@query(f"{WITH} SELECT id, CASE WHEN id % 8 = 2 THEN 'new' ELSE label END AS label FROM v UNION ALL SELECT id * 8 + 5, label FROM v WHERE label = 'PROMO'")
def add_vertices(spark, sf_dir):
    g = trade(spark, sf_dir)
    new = g.vertices.where("id % 8 = 2").select("id", F.lit("new").alias("label")).unionByName(g.vertices.where("label = 'PROMO'").select((F.col("id") * 8 + 5).alias("id"), "label"))
    return navigate.add_vertices(g, new).vertices


@query(f"{WITH} SELECT count(*) AS n_vertices, CAST(0 AS BIGINT) AS n_edges FROM v")
def copy_without_edges(spark, sf_dir):
    g = navigate.cleared(trade(spark, sf_dir), vertices_too=False)
    return g.vertices.agg(F.count("*").alias("n_vertices")).crossJoin(g.edges.agg(F.count("*").alias("n_edges")))  # a row each


@query(f"{WITH}, c AS (SELECT src, list_sort(list(DISTINCT dst)) AS l FROM e GROUP BY 1) SELECT id, label, array_to_string(l, ' ') AS children FROM v LEFT JOIN c ON c.src = id ORDER BY id LIMIT 20")
def display_graph(spark, sf_dir):
    return navigate.display(trade(spark, sf_dir), 20).select("id", "label", F.array_join("children", " ").alias("children"))


@query(f"{WITH}, k AS (SELECT id FROM v WHERE label IN ('PROMO', 'S1', 'S2')) SELECT src, dst FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def induced_subgraph(spark, sf_dir):
    g = trade(spark, sf_dir)
    return navigate.subgraph(g, g.vertices.where("label in ('PROMO', 'S1', 'S2')")).edges


@query(f"{OWNED} SELECT src, dst FROM x WHERE p = 1 AND q = 1")
def extract_part(spark, sf_dir):
    return navigate.extract_part(*owned(spark, sf_dir), 1).edges


@query(f"{OWNED} SELECT p AS pid, src, dst FROM x WHERE p = q")
def split_by_part(spark, sf_dir):
    return navigate.split(*owned(spark, sf_dir))


@query(f"{OWNED}, n AS (SELECT pid, id, row_number() OVER (ORDER BY pid, id) - 1 AS place FROM w) SELECT pid, min(place) OVER (PARTITION BY pid) AS \"first\", place, id FROM n")
def part_members(spark, sf_dir):
    return navigate.members(owned(spark, sf_dir)[1])


@query(f"{WITH}, a AS (SELECT src, dst FROM t WHERE src <> dst), z AS (SELECT src, dst, count(*) AS n FROM a GROUP BY 1, 2), y AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, CAST(max(n) AS DOUBLE) AS w FROM z GROUP BY 1, 2) SELECT a AS src, b AS dst, w FROM y UNION ALL SELECT b, a, w FROM y")
def graph_fix(spark, sf_dir):
    from ..graph import Graph

    return fragment.graph_fix(Graph(trade(spark, sf_dir).vertices, traded(spark, sf_dir)))


# ---- fixpoints, programs ------------------------------------------------------


@query(f"{LOOP}, b(id, dist) AS (SELECT CAST(10 AS BIGINT), 0 UNION SELECT u.dst, b.dist + 1 FROM b JOIN u ON u.src = b.id WHERE b.dist < 12), l AS (SELECT id, min(dist) AS dist FROM b GROUP BY 1) SELECT id, row_number() OVER (ORDER BY dist, id) - 1 AS place FROM l")
def bfs_order(spark, sf_dir):
    edges = materialize(trade(spark, sf_dir).undirected(), "trade")
    return traverse.ordered(traverse.bfs(edges, spark.createDataFrame([(10,)], "id long")))


@query(f"WITH RECURSIVE {VISITS}, s AS (SELECT min(event_id) AS id FROM events), w(id, dist) AS (SELECT id, 0 FROM s UNION SELECT ee.dst, w.dist + 1 FROM w JOIN ee ON ee.src = w.id) SELECT event_id AS id, CAST(coalesce(2 * dist, -1) AS DOUBLE) AS dist FROM events LEFT JOIN w ON w.id = event_id")
def sssp_unreachable(spark, sf_dir):
    g = visits(spark, sf_dir)
    first = g.vertices.agg(F.min("id")).first()[0]
    return traverse.distances(g, materialize(g.edges.withColumn("w", F.lit(2.0)), "visits"), first)


@query(f"WITH {VISITS} SELECT event_id AS id, min(event_id) OVER (PARTITION BY user_id) AS value FROM ev")
def program_least_id(spark, sf_dir):
    return program.run(visits(spark, sf_dir), program.Query("least_id"))


@query(f"{LOOP}, b(id, dist) AS (SELECT CAST(10 AS BIGINT), 0 UNION SELECT e.dst, b.dist + 1 FROM b JOIN e ON e.src = b.id WHERE b.dist < 12), l AS (SELECT id, min(dist) AS dist FROM b GROUP BY 1) SELECT CAST(v.id % 3 AS INTEGER) AS pid, v.id, CAST(l.dist AS BIGINT) AS value FROM v LEFT JOIN l USING (id)")
def program_hops_by_part(spark, sf_dir):
    g, owner = owned(spark, sf_dir)
    return program.run(g, program.Query("hops", {"source": 10}, assemble=False), owner)


@query(f"{_walk(4, 'CAST(id AS DOUBLE) / (SELECT sum(id) FROM v)').rsplit(' SELECT ', 1)[0]}, k AS (SELECT id, round(rank, 9) AS rank FROM r4), s AS (SELECT src, dst, abs(a.rank - b.rank) AS step FROM e JOIN k a ON a.id = src JOIN k b ON b.id = dst) SELECT round(max(step), 8) AS step FROM s")
def rank_difference(spark, sf_dir):
    g = trade(spark, sf_dir, True)
    total = g.vertices.agg(F.sum("id")).first()[0] or 1
    ranks = pagerank.random_walk(g, iterations=4, restart=g.vertices.select("id", (F.col("id") / total).alias("r")))
    found = pagerank.largest_step(g, ranks.select("id", F.round("rank", 9).alias("rank")))
    return found.select(F.round("step", 8).alias("step"))


# ---- fragments and meshes -----------------------------------------------------


@query(f"{OWNED}, b AS (SELECT src AS id, p AS pid FROM x WHERE p <> q UNION SELECT dst, q FROM x WHERE p <> q) SELECT w.pid, round(CAST(count(b.id) AS DOUBLE) / count(*), 10) AS border_ratio FROM w LEFT JOIN b ON b.id = w.id AND b.pid = w.pid GROUP BY 1")
def border_ratio(spark, sf_dir):
    return fragment.border_ratio(*owned(spark, sf_dir)).withColumn("border_ratio", F.round("border_ratio", 10))


@query(f"{OWNED}, g(pid, target) AS (VALUES (0, 0.5), (1, 0.25), (2, 0.25)) SELECT CAST(g.pid AS INTEGER) AS pid, round(CAST((SELECT count(*) FROM w WHERE w.pid = g.pid) AS DOUBLE) / (CAST(g.target AS DOUBLE) * (SELECT count(*) FROM w)), 10) AS load FROM g")
def target_balance(spark, sf_dir):
    return fragment.target_balance(owned(spark, sf_dir)[1], [0.5, 0.25, 0.25]).withColumn("load", F.round("load", 10))


@query(f"{OWNED} SELECT CAST(sum(1 + src % 5) AS BIGINT) AS sized_volume FROM (SELECT DISTINCT src, q FROM y WHERE p <> q)")
def sized_volume(spark, sf_dir):
    g, owner = owned(spark, sf_dir)
    return fragment.sized_volume(g, owner, g.vertices.select("id", (1 + F.col("id") % 5).alias("vsize")))


_ELEMENTS = f"WITH {MESH}, o AS (SELECT DISTINCT element, CAST(element % 4 AS INTEGER) AS pid FROM m)"


def elements(spark, sf_dir):
    return mesh(spark, sf_dir).select(F.col("element").alias("id"), (F.col("element") % 4).cast("int").alias("pid")).distinct()


@query(f"{_ELEMENTS}, n AS (SELECT node, pid, count(*) AS n FROM m JOIN o USING (element) GROUP BY 1, 2) SELECT node AS id, arg_min(pid, -n * 10 + pid) AS pid FROM n GROUP BY 1")
def mesh_node_parts(spark, sf_dir):
    return fragment.mesh_owner(mesh(spark, sf_dir), elements(spark, sf_dir))


@query(f"{_ELEMENTS}, a AS (SELECT pid, count(*) AS n FROM o GROUP BY 1), b AS (SELECT pid, count(DISTINCT node) AS n FROM m JOIN o USING (element) GROUP BY 1) SELECT (SELECT CAST(max(n) * 4 AS DOUBLE) / sum(n) FROM a) AS element_balance, (SELECT CAST(max(n) * 4 AS DOUBLE) / sum(n) FROM b) AS node_balance")
def element_balance(spark, sf_dir):
    return fragment.element_balance(mesh(spark, sf_dir), elements(spark, sf_dir), 4)


# ---- orders, matrices, itemsets -----------------------------------------------


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS place FROM part")
def sorted_pairs(spark, sf_dir):
    return order.numbered(read_table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), F.col("p_partkey")], "place").select("p_partkey", "place")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def k_select(spark, sf_dir):
    return read_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)


@query(f"{WITH}, p AS (SELECT count(*) AS n, count(DISTINCT id) AS d FROM v) SELECT n AS n_places, d AS n_ids, n - 1 AS last FROM p")
def random_permutation(spark, sf_dir):
    found = navigate.permuted(trade(spark, sf_dir).vertices.select("id"), seed=7)
    return found.agg(F.countDistinct("place").alias("n_places"), F.countDistinct("id").alias("n_ids"), F.max("place").alias("last"))


@query(f'{CELLS} SELECT col AS "row", "row" AS col, val FROM c')
def matrix_transpose(spark, sf_dir):
    return matrix.transpose(cells(spark, sf_dir))


@query(f'{CELLS} SELECT CAST("row" % 3 AS INTEGER) AS color, "row", col, val FROM c')
def matrix_split(spark, sf_dir):
    m = materialize(cells(spark, sf_dir), "cells")
    return matrix.merged(m, m.select("row", (F.col("row") % 3).cast("int").alias("color")).distinct())


@query(f'{CELLS} SELECT "row", col, val FROM c WHERE col IN (SELECT col FROM c GROUP BY 1 HAVING count(*) BETWEEN 900 AND (SELECT max(n) - 1 FROM (SELECT count(*) AS n FROM c GROUP BY col)))')
def matrix_prune_columns(spark, sf_dir):
    m = materialize(cells(spark, sf_dir), "cells")
    most = m.groupBy("col").count().agg(F.max("count")).first()[0]
    return matrix.prune(m, 900, most - 1, "col")


def _low(norm: int, what: str) -> str:
    other, size = ("col" if what == "row" else "row"), ("abs(val)" if norm == 1 else "val * val")
    root = "" if norm == 1 else "sqrt"
    return f'{CELLS}, s AS (SELECT *, coalesce(sum({size}) OVER (PARTITION BY "{what}" ORDER BY val DESC, "{other}" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum({size}) OVER (PARTITION BY "{what}") AS t FROM c) SELECT "row", col, val FROM s WHERE {root}(b) <= CAST(0.5 AS DOUBLE) * {root}(t)'


for _norm, _what in ((1, "row"), (1, "col"), (2, "col")):
    query(_low(_norm, _what), f"matrix_lowfilter_l{_norm}_{_what}")(lambda spark, sf_dir, n=_norm, w=_what: matrix.low_filter(cells(spark, sf_dir), 0.5, n, w))
    _size = f'sum(abs(val)) OVER (PARTITION BY "{_what}")' if _norm == 1 else f'sqrt(sum(val * val) OVER (PARTITION BY "{_what}"))'
    query(f'{CELLS} SELECT "row", col, round(val / {_size}, 9) AS val FROM c', f"matrix_normalize_l{_norm}_{_what}")(lambda spark, sf_dir, n=_norm, w=_what: matrix.normalize(cells(spark, sf_dir), n, w).withColumn("val", F.round("val", 9)))


@query(f'{CELLS}, s AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY val DESC, "row") AS r FROM c) SELECT "row", col, val FROM s WHERE r <= 5 OR val >= 180')
def matrix_topkplus_columns(spark, sf_dir):
    return matrix.topk_plus(cells(spark, sf_dir), 5, 180.0, "col")


@query(f'{CELLS}, s AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY val DESC, "row") AS r FROM c) SELECT "row", col, val FROM s WHERE r <= 7')
def matrix_top_columns(spark, sf_dir):
    return matrix.top_columns(cells(spark, sf_dir), 7)


@query(f"{CELLS} SELECT col, sum(val) AS total, sum(val * val) AS squared_norm FROM c GROUP BY 1")
def matrix_sums_columns(spark, sf_dir):
    return matrix.sums(cells(spark, sf_dir), "col")


@query(f'{CELLS}, q AS (SELECT col, val FROM c WHERE "row" = (SELECT min("row") FROM c)), n AS (SELECT "row", sum(val * val) AS n FROM c GROUP BY 1), z AS (SELECT a."row", sum(a.val * b.val) AS s FROM c a JOIN q b USING (col) GROUP BY 1) SELECT "row", round(s / sqrt(n * (SELECT sum(val * val) FROM q)), 7) AS sim FROM z JOIN n USING ("row") WHERE s / sqrt(n * (SELECT sum(val * val) FROM q)) >= 0.2 ORDER BY s / sqrt(n * (SELECT sum(val * val) FROM q)) DESC, "row" LIMIT 10')
def similar_rows_top(spark, sf_dir):
    m = materialize(cells(spark, sf_dir), "cells")
    first = m.agg(F.min("row")).first()[0]
    return matrix.similar_rows(m, m.where(F.col("row") == first).select("col", "val"), "cos", 0.2, 10).withColumn("sim", F.round("sim", 7))


_PAIR = {"jac": ("val * val", "a.val * b.val", "s / (n + t - s)"), "min": ("abs(val)", "least(a.val, b.val)", "s / (n + t - s)"), "amin": ("abs(val)", "least(a.val, b.val)", "s / t")}
for _measure, (_size, _part, _sim) in _PAIR.items():

    def _similar_pairs(spark, sf_dir, measure=_measure):
        m = materialize(cells(spark, sf_dir), "cells")
        rows = m.select("row").distinct()
        pairs = rows.withColumn("row2", F.col("row") + 1).join(rows.select(F.col("row").alias("row2")), "row2", "left_semi").select("row", "row2")
        return matrix.row_similarity(m, pairs, measure).withColumn("sim", F.round("sim", 8))

    query(f'{CELLS}, n AS (SELECT "row", sum({_size}) AS n FROM c GROUP BY 1), z AS (SELECT a."row", b."row" AS row2, sum({_part}) AS s FROM c a JOIN c b ON b."row" = a."row" + 1 AND a.col = b.col GROUP BY 1, 2), y AS (SELECT n."row", n2."row" AS row2, coalesce(z.s, 0) AS s, n.n, n2.n AS t FROM n JOIN n n2 ON n2."row" = n."row" + 1 LEFT JOIN z ON z."row" = n."row") SELECT "row", row2, round({_sim}, 8) AS sim FROM y', f"row_similarity_{_measure}")(_similar_pairs)


@query(f"{BASKETS}, f AS (SELECT item FROM b GROUP BY 1 HAVING count(*) BETWEEN 10 AND (SELECT max(n) - 1 FROM (SELECT count(*) AS n FROM b GROUP BY item))), k AS (SELECT * FROM b WHERE item IN (SELECT item FROM f)) SELECT x.item || ',' || y.item AS items, count(*) AS support, sum(basket) AS baskets FROM k x JOIN k y USING (basket) WHERE x.item < y.item GROUP BY 1 HAVING count(*) >= 10 UNION ALL SELECT x.item || ',' || y.item || ',' || z.item, count(*), sum(basket) FROM k x JOIN k y USING (basket) JOIN k z USING (basket) WHERE x.item < y.item AND y.item < z.item GROUP BY 1 HAVING count(*) >= 10")
def itemsets_bounded(spark, sf_dir):
    b = materialize(baskets(spark, sf_dir), "baskets")
    most = b.groupBy("item").count().agg(F.max("count")).first()[0]
    found = matrix.itemsets_between(b, 10, most - 1, 2, 3, with_baskets=True)
    total = F.aggregate("baskets", F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(F.array_join("items", ",").alias("items"), "support", total.cast("decimal(38,0)").cast("long").alias("baskets"))


@query(f"{SCORED} SELECT round(coalesce(CAST(sum(n * (tp - CAST(p AS DOUBLE) / 2)) AS DOUBLE) / (max(np) * max(fp)), 0), 10) AS roc_n FROM r WHERE fp - n < 50")
def roc_n(spark, sf_dir):
    return evaluate.roc_n(scored(spark, sf_dir), 50).select(F.round("roc_n", 10).alias("roc_n"))


# ---- scalars ------------------------------------------------------------------


@query("SELECT event_id, date_trunc('second', ts) AS at FROM events")
def text_time(spark, sf_dir):
    return read_table(spark, sf_dir, "events").select("event_id", scalars.text_time(scalars.time_text(F.col("ts"))).alias("at"))


@query("WITH x AS (SELECT vec_id, list_transform(embedding, lambda y: CAST(y AS DOUBLE)) AS v FROM embeddings) SELECT vec_id, round(list_sum(list_transform(v, lambda y: 2.5::DOUBLE * y + y)), 5) AS axpy_total, round(list_sum(list_transform(v, lambda y: 3 * y)), 5) AS scaled_total FROM x")
def vec_axpy(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return read_table(spark, sf_dir, "embeddings").select("vec_id", F.round(scalars.total(scalars.axpy(2.5, v, v)), 5).alias("axpy_total"), F.round(scalars.total(scalars.scaled(3.0, v)), 5).alias("scaled_total"))


@query("SELECT p_partkey, bit_count(p_partkey + 1) = 1 AS power, CAST(floor(log2(p_partkey + 1)) AS INTEGER) AS low, CAST(ceil(log2(p_partkey + 1)) AS INTEGER) AS high FROM part")
def logarithms(spark, sf_dir):
    k = F.col("p_partkey") + 1
    return read_table(spark, sf_dir, "part").select("p_partkey", scalars.is_power_of_two(k).alias("power"), scalars.floor_log2(k).alias("low"), scalars.ceil_log2(k).cast("int").alias("high"))


@query("SELECT p_partkey, translate(p_name, 'aeiou#', '43105_') AS replaced, ltrim(p_name, 'Part#0') AS pruned_left, rtrim(p_name, '0123456789') AS pruned_right, upper(p_name) AS upper, lower(p_name) AS lower, lower(p_name) = lower(upper(p_name)) AS same, CASE WHEN reverse(p_name) = reverse(p_brand) THEN 0 WHEN reverse(p_name) < reverse(p_brand) THEN -1 ELSE 1 END AS from_end FROM part")
def string_helpers(spark, sf_dir):
    name, brand = F.col("p_name"), F.col("p_brand")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey", scalars.replaced_characters(name, "aeiou#", "43105_").alias("replaced"), scalars.trimmed(name, "Part#0", right=False).alias("pruned_left"), scalars.trimmed(name, "0123456789", left=False).alias("pruned_right"),
        F.upper(name).alias("upper"), F.lower(name).alias("lower"), scalars.same_text(name, F.upper(name), True).alias("same"), scalars.compared_from_end(name, brand).alias("from_end"),
    )


@query("SELECT p_partkey, CAST(coalesce(list_position([" + ", ".join(f"'{t}'" for t in TYPES[:4]) + "], p_type) - 1, -1) AS INTEGER) AS kind FROM part")
def enum_lookup(spark, sf_dir):
    return read_table(spark, sf_dir, "part").select("p_partkey", scalars.enum_id(F.col("p_type"), {t: i for i, t in enumerate(TYPES[:4])}).alias("kind"))


@query("SELECT c_custkey, regexp_replace(c_name, '([a-z]+)#0', '<\\1>', 'i') AS first_only, regexp_replace(c_name, '0', '.') AS first_zero FROM customer")
def regex_replace_first(spark, sf_dir):
    c = F.col("c_name")
    return read_table(spark, sf_dir, "customer").select("c_custkey", scalars.replace_regex(c, "([a-z]+)#0", "<$1>", ignore_case=True, everywhere=False).alias("first_only"), scalars.replace_regex(c, "0", ".", everywhere=False).alias("first_zero"))
