import itertools
import random

import pytest
from pyspark.sql import functions as F

from weftgraph import options
from weftgraph.graph import Graph
from weftgraph.operators import components, fragment, matrix, navigate, pagerank, partition, program, simulation, traverse
from weftgraph.operators.order import numbered
from weftgraph.sources import files
from weftgraph.streaming.deletes import LiveSimulation

# The sample graph's labels and edges, and its fragments' owners.
LABELS = {1: "f", 2: "yb", 3: "sp", 4: "yf", 5: "f", 6: "sp", 7: "f", 8: "yf", 9: "yb", 10: "f", 11: "sp", 12: "yf", 13: "yb"}
EDGES = [
    (1, 5), (2, 1), (2, 4), (3, 2), (3, 4), (3, 7), (3, 8), (4, 1), (4, 7), (5, 6), (6, 4), (6, 5), (7, 3), (8, 3), (8, 9), (8, 10), (9, 6), (9, 8), (9, 10), (10, 11), (11, 12), (12, 6), (13, 5), (13, 12),
]
OWNERS = {1: 0, 2: 0, 3: 0, 4: 0, 5: 2, 6: 2, 7: 1, 8: 1, 9: 1, 10: 1, 11: 1, 12: 2, 13: 2}
PATTERN = simulation.Pattern(((0, "yb"), (1, "yf"), (2, "f"), (3, "sp")), ((0, 1), (0, 2), (1, 2), (2, 3), (3, 1)))


@pytest.fixture(scope="module")
def g(spark):
    return Graph(spark.createDataFrame(list(LABELS.items()), "id long, label string"), spark.createDataFrame(EDGES, "src long, dst long"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_simulation_of_the_sample(g):
    assert rows(simulation.simulation(g.check(), PATTERN)) == [(1, 4), (2, 5), (2, 7), (3, 3), (3, 6)]


def test_simulation_against_brute_force(spark):
    rng = random.Random(3)
    for _ in range(2):
        n = 9
        labels = {i: rng.choice("ab") for i in range(n)}
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(16)}
        p = simulation.Pattern(((0, "a"), (1, "b"), (2, "a")), ((0, 1), (1, 2), (2, 2)))
        found = {(u, v) for u, x in p.nodes for v in labels if labels[v] == x}
        while bad := {(u, v) for u, v in found if any(not any((v, w) in edges and (b, w) in found for w in labels) for a, b in p.edges if a == u)}:
            found -= bad
        graph = Graph(spark.createDataFrame(list(labels.items()), "id long, label string"), spark.createDataFrame(sorted(edges), "src long, dst long"))
        assert rows(simulation.simulation(graph, p)) == sorted(found)


def test_distances(g):
    assert dict(rows(traverse.eccentricity(g, g.vertices.select("id")))) == dict(zip(range(1, 14), (4, 4, 4, 3, 3, 2, 4, 4, 3, 4, 4, 3, 4)))
    assert traverse.diameter(g).first()[0] == 4
    near = traverse.ego(g, 4, 1)
    assert rows(near.vertices.select("id")) == [(i,) for i in (1, 2, 3, 4, 6, 7)]
    assert rows(near.edges) == [(2, 4), (3, 4), (4, 1), (4, 7), (6, 4)]
    assert traverse.has_cycles(g).first()[0]


def test_fragments(spark, g):
    owner = spark.createDataFrame(sorted(OWNERS.items()), "id long, pid int")
    crossing = fragment.fragment_edges(g, owner).where("tag = 1").select("src", "dst")
    assert rows(crossing) == [(1, 5), (3, 7), (3, 8), (4, 7), (6, 4), (7, 3), (8, 3), (9, 6), (11, 12)]
    assert fragment.virtual_vertices(g, owner).count() == 10


def test_adjacency_and_messages(spark, tmp_path):
    golden = {1: 0.5, 2: 0.5}
    (tmp_path / "a.dat").write_text("1 x 2\n2 y\n")
    graph = files.read_adjacency(spark, str(tmp_path / "a.dat"))
    ranks = dict(rows(pagerank.message_driven(graph)))
    assert ranks == {1: golden[1], 2: pytest.approx(0.425)}
    (tmp_path / "b.v").write_text("1\tx\n2\ty")
    (tmp_path / "b.e").write_text("1\t2")
    assert rows(files.read_ve(spark, str(tmp_path / "b")).check().edges) == [(1, 2)]


def test_random_walk_keeps_its_mass(g):
    assert pagerank.random_walk(g).agg(F.sum("rank")).first()[0] == pytest.approx(1)


def test_metis_round_trip(spark, tmp_path):
    (tmp_path / "m").write_text("% note\n3 2 001\n2 5\n1 5 3 7\n2 7\n")
    vertices, edges = files.read_metis(spark, str(tmp_path / "m"))
    assert rows(edges) == [(1, 2, 5.0), (2, 1, 5.0), (2, 3, 7.0), (3, 2, 7.0)]
    files.write_metis(vertices, edges, str(tmp_path / "out"))
    assert rows(files.read_metis(spark, str(tmp_path / "out"))[1]) == rows(edges)
    assert files.parse_target_weights("0-1=0.25", 3) == [[0.25], [0.25], [0.5]]


def test_partition_beats_hashing_and_balances(spark):
    n = 240
    ring = [(i, (i + 1) % n) for i in range(n)] + [(i, (i + 2) % n) for i in range(n)]
    graph = Graph(spark.createDataFrame([(i, "x") for i in range(n)], "id long, label string"), spark.createDataFrame(ring, "src long, dst long"))
    owner = partition.multilevel(graph, 3, imbalance=0.1, coarse=60, passes=2)
    assert owner.count() == n
    assert fragment.edge_cut(graph, owner).first()[0] < fragment.edge_cut(graph, fragment.hash_owner(graph, 3)).first()[0] / 2
    assert fragment.balance(owner, 3).first()[0] < 1.35


def test_a_level_contracts_hubs(spark):
    """Matching by pairs took at most a vertex for each hub; so a level kept nearly all vertices and contraction stalled."""
    rng = random.Random(5)
    shared = [(1000 + i, h, 1.0) for i in range(1000) for h in rng.sample(range(20), 3)]
    single = [(3000 + i, 5000, 1.0) for i in range(400)]  # leaves of one hub
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in shared + single], "src long, dst long, ew double")
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("w", F.lit(1.0))
    match = partition._match(vertices, edges, 100.0, 1)
    sizes = [r["count"] for r in match.groupBy("coarse_id").count().collect()]
    assert sum(sizes) == match.select("id").distinct().count() == 1421 and len(sizes) < 700 and max(sizes) < 200
    coarse = match.where("coarse_id >= 3000 and coarse_id <= 5000 and id >= 3000").select("coarse_id").distinct().count()
    assert coarse < 100


def test_components_and_empty_graphs(spark, g):
    assert {c for _, c in rows(components.connected_components(g.edges))} == {1}
    empty = Graph(g.vertices.limit(0), g.edges.limit(0))
    assert simulation.simulation(empty, PATTERN).count() == 0
    assert pagerank.random_walk(empty).count() == 0
    assert not traverse.has_cycles(empty).first()[0]
    assert rows(navigate.degree(Graph(g.vertices, g.edges.limit(0))).where("degree > 0")) == []


def test_live_simulation_under_deletes_and_restarts(spark, g, tmp_path):
    gone = lambda *e: spark.createDataFrame(list(e), "src long, dst long")
    live = LiveSimulation(g, PATTERN, f"file://{tmp_path}/live")
    assert rows(live.apply(gone((5, 6)), 0)) == rows(simulation.simulation(navigate.remove_edges(g, gone((5, 6))), PATTERN))
    want = rows(simulation.simulation(navigate.remove_edges(g, gone((5, 6), (7, 3))), PATTERN))
    again = LiveSimulation(g, PATTERN, f"file://{tmp_path}/live")  # as after a restart
    assert again.version == 0 and rows(again.apply(gone((5, 6)), 0)) == rows(live.result)
    assert rows(again.apply(gone((7, 3)), 1)) == want


def test_live_simulation_on_a_stream(spark, g, tmp_path):
    (tmp_path / "in").mkdir()
    live = LiveSimulation(g, PATTERN, f"file://{tmp_path}/live")
    stream = spark.readStream.schema("src long, dst long").json(f"file://{tmp_path}/in")
    for k, edge in enumerate([(5, 6), (7, 3)]):
        (tmp_path / "in" / f"{k}.json").write_text('{"src": %d, "dst": %d}' % edge)
        run = live.attach(stream, f"file://{tmp_path}/checkpoint")
        run.processAllAvailable()
        run.stop()
    assert live.version == 1
    assert rows(live.result) == rows(simulation.simulation(navigate.remove_edges(g, spark.createDataFrame([(5, 6), (7, 3)], "src long, dst long")), PATTERN))


def test_distances_against_brute_force(spark):
    rng = random.Random(8)
    edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(20)}
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(14)}
    far = {}
    for s in near:
        level, seen = {s: 0}, [s]
        for v in seen:
            for w in sorted(near[v] - level.keys()):
                level[w] = level[v] + 1
                seen.append(w)
        far[s] = level
    graph = Graph(spark.createDataFrame([(i, "x") for i in range(14)], "id long, label string"), spark.createDataFrame(sorted(edges), "src long, dst long"))
    assert dict(rows(traverse.eccentricity(graph, graph.vertices.select("id")))) == {s: max(x.values()) for s, x in far.items()}
    assert traverse.diameter(graph).first()[0] == max(max(x.values()) for x in far.values())
    found = {(i, c) for i, c in rows(components.connected_components(graph.edges))}
    assert found == {(i, min(far[i])) for i in near if len(far[i]) > 1}
    cyclic = {(a, b) for a, b in edges}
    while True:
        left = {(a, b) for a, b in cyclic if a in {y for _, y in cyclic} and b in {x for x, _ in cyclic}}
        if left == cyclic:
            break
        cyclic = left
    assert {tuple(r) for r in rows(traverse.cyclic_core(graph))} == cyclic


def test_few_searches_bound_all_distances(spark, monkeypatch):
    """A search from every vertex held as many rows as there are pairs."""
    held, search = [], traverse.bfs

    def counted(edges, sources, bound=None):
        found = search(edges, sources, bound)
        held.append(found.count())
        return found

    monkeypatch.setattr(traverse, "bfs", counted)
    n = 600  # two stars of stars, a pair and a lone vertex
    edges = [(i, 1000 + i % 7) for i in range(n)] + [(1000 + i, 2000 + i % 2) for i in range(7)] + [(3000, 3001)]
    ids = sorted({x for e in edges for x in e} | {4000})
    graph = Graph(spark.createDataFrame([(i, "x") for i in ids], "id long, label string"), spark.createDataFrame(edges, "src long, dst long"))
    want = {i: 4 if i < 1000 else 3 if i < 2000 else 2 if i < 3000 else 1 if i < 4000 else 0 for i in ids}
    assert dict(rows(traverse.eccentricity(graph, graph.vertices.select("id")))) == want
    assert traverse.diameter(graph).first()[0] == 4
    assert sum(held) < 40 * n


def test_many_edges_are_dealt_before_they_meet(g):
    """A task's map held all rows of a file's split, and of a partition that grew with the table."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    many = Graph(g.vertices, g.edges, 8_000_000)
    for found in (many.once(), many.undirected(), fragment.owned_edges(Graph(g.vertices, many.once()), fragment.hash_owner(g, 3))):
        assert "REPARTITION_BY_NUM" in plan(found)
    assert "REPARTITION_BY_NUM" not in plan(g.once()) and rows(many.undirected()) == rows(g.undirected())


def test_mesh_pairs_of_a_node_in_many_elements(spark, monkeypatch):
    """All pairs of a node came from one task."""
    monkeypatch.setattr(fragment, "_SHARE", 5)
    cells = [(e, 0) for e in range(23)] + [(e, 1 + e % 4) for e in range(23)] + [(30, 9), (31, 9), (30, 9)]
    mesh = spark.createDataFrame(cells, "element long, node long")
    want = sorted({(a, b) for a, x in cells for b, y in cells if x == y and a < b})
    assert rows(fragment.mesh_dual(mesh)) == want
    assert rows(fragment.mesh_dual(mesh, 2)) == sorted((a, b) for a, b in want if b < 23 and a % 4 == b % 4)


def test_a_long_chain_needs_few_rounds(spark, monkeypatch):
    """The least id went one vertex a round, and a chain lost two vertices a round."""
    n, written = 400, []
    write = traverse.materialize
    monkeypatch.setattr(traverse, "materialize", lambda df, tag: written.append(tag) or write(df, tag))
    vertices = spark.range(n).select("id", F.lit("x").alias("label"))
    chain = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert rows(program.run(Graph(vertices, chain), program.Query("least_id", rounds=20))) == [(i, 0) for i in range(n)]
    assert not traverse.has_cycles(Graph(vertices, chain)).first()[0] and len(written) < 60
    closed = chain.unionByName(spark.createDataFrame([(n - 1, 7)], "src long, dst long"))
    assert traverse.has_cycles(Graph(vertices, closed)).first()[0]


def test_links_are_lists(spark):
    """A row for each edge was dealt again in each round."""
    edges = spark.range(1, 10_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst")).union(spark.createDataFrame([(5, 0), (6, 0)], "src long, dst long"))
    out, links = pagerank._links(edges)
    assert rows(out) == [(0, 10_000), (5, 1), (6, 1)] and links.count() == 5
    assert rows(links.select("src", F.explode("to"))) == rows(edges)


def test_a_scaled_matrix_is_computed_once(spark):
    """The cells were computed for the rows, for the columns and for the result."""
    m = spark.createDataFrame([(i, i % 3, 2.0) for i in range(9)] + [(0, 1, 4.0)], "row long, col long, val double")
    for how in ("idf", "idf2"):
        found = matrix.scale(m, how)
        assert found.count() == 10 and found.inputFiles() and all("/scale-" in f for f in found.inputFiles())


def test_fragment_files_round_trip(spark, g, tmp_path):
    owner = spark.createDataFrame(sorted(OWNERS.items()), "id long, pid int")
    path = f"file://{tmp_path}/s"
    files.write_fragments(g, owner, path, 3)
    found = files.read_fragments(spark, path)
    assert rows(found.graph.vertices) == sorted(LABELS.items()) and rows(found.graph.edges) == sorted(EDGES)
    assert rows(found.borders) == rows(fragment.border(g, owner)) and rows(found.owner) == rows(fragment.virtual_vertices(g, owner))
    assert rows(found.edges) == rows(fragment.fragment_edges(g, owner).select("pid", "src", "dst"))
    assert found.vertices.groupBy("pid").count().orderBy("pid").collect()[0]["count"] == 4 + 4
    (tmp_path / "s.p7.v").write_text("1\tother\n")
    with pytest.raises(ValueError):
        files.read_fragments(spark, path)


def test_small_readers_and_writers(spark, tmp_path):
    (tmp_path / "ids").write_text("3 4\n\n4 5")
    assert rows(files.read_ids(spark, str(tmp_path / "ids"))) == [(3,), (4,), (5,)]
    (tmp_path / "map").write_text("1\t7\n2\t8\n")
    assert rows(files.read_map(spark, str(tmp_path / "map"))) == [(1, 7), (2, 8)]
    (tmp_path / "map").write_text("1\t7\n1\t8\n")
    with pytest.raises(ValueError):
        files.read_map(spark, str(tmp_path / "map"))
    (tmp_path / "mesh").write_text("2\n1 2 3\n2 3 4\n")
    assert rows(files.read_mesh(spark, str(tmp_path / "mesh"))) == [(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (2, 4)]
    cells = spark.createDataFrame([(0, 0, 1.5), (0, 3, 2.0), (1, 1, 4.0)], "row long, col long, val double")
    files.write_matrix(cells, str(tmp_path / "matrix"))
    assert rows(files.read_matrix(spark, str(tmp_path / "matrix"), header=False)) == rows(cells)
    (tmp_path / "q.v").write_text("0\ta\n1\tb")
    (tmp_path / "q.e").write_text("0\t1\n1\t0")
    assert files.read_pattern(spark, str(tmp_path / "q")) == simulation.Pattern(((0, "a"), (1, "b")), ((0, 1), (1, 0)))
    owner = spark.createDataFrame([(3, 1), (1, 0), (2, 2)], "id long, pid int")
    files.write_partition(owner, str(tmp_path / "part"))
    assert rows(files.read_partition(spark, str(tmp_path / "part"))) == rows(owner)
    assert navigate.random_vertex(Graph(cells.select(F.col("row").alias("id"), F.lit("x").alias("label")), cells.select(F.col("row").alias("src"), F.col("col").alias("dst")))).count() == 1


def test_options_and_programs(spark, g):
    found = options.parse("# note\nparts = 4\n strategy=range\nassemble: false\n\nlist = a, b ,\n")
    assert options.Options.of(found) == options.Options(strategy="range", parts=4, assemble=False)
    assert options.value(found, "list", [], list) == ["a", "b"] and options.value(found, "missing", 7) == 7
    with pytest.raises(ValueError):
        options.value({"assemble": "maybe"}, "assemble", True)

    @program.program
    def heaviest(weights: dict) -> program.Program:
        """The largest weight along any path into a vertex."""
        weight = F.lit(0)
        for k, w in weights.items():
            weight = F.when(F.col("id") == k, w).otherwise(weight)
        return program.Program(lambda: weight, lambda: F.col("value"), F.max, lambda v, m: F.greatest(v, m))

    got = dict(rows(program.run(g, program.Query("heaviest", {"weights": {13: 9, 1: 5}}))))
    assert got[13] == 9 and got[5] == 9 and got[1] == 9 and got[9] == 9
    with pytest.raises(KeyError):
        program.run(g, program.Query("nothing"))
    assert fragment.owner(g, 3, "range").count() == 13


def test_numbers_and_itemsets(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    assert [r[2] for r in sorted(numbered(df, [F.col("k"), F.col("id")]).collect())] == list(range(1000))
    baskets = [(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b"), (3, "a"), (3, "c"), (3, "c")]
    found = rows(matrix.itemsets(spark.createDataFrame(baskets, "basket long, item string"), 2, 2))
    assert found == [(["a", "b"], 2), (["a", "c"], 2)]
    assert len(list(itertools.combinations("abc", 2))) == 3
