"""The queries of the graph, iterative and matrix operators, with the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import combine, kmeans, matrix, pagerank, paths, shortest
from .plans import introspect
from .plans.checkpoint import materialise, new_path
from .sources import generators, readers, sinks
from .sources import tables as t

BOUND = 500
SOURCES = [1, 2]
K = 100

QUERIES: dict = {}
SQL: dict[str, str] = {}

EDGES = f"WITH RECURSIVE e AS ({t.COPURCHASE_SQL})"
BAG = f"WITH e AS ({t.USER_SEQUENCE_SQL})"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


# --- sources and sinks


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges as text lines, and as node lines all parts and, for users whom no one follows, their ids with a minus; written
    as text and read again."""
    path, parts = new_path(spark, "lines"), t.read(spark, sf_dir, "part").select("p_partkey")
    sinks.write_delimited(t.copurchase(spark, sf_dir), f"{path}/edges", ",")
    sinks.write_delimited(parts.union(parts.select(-F.col("p_partkey"))), f"{path}/nodes", ",")
    return readers.text_lines(spark, [f"{path}/edges", f"{path}/nodes"])


@query(f"""{EDGES} SELECT CAST(k AS VARCHAR) AS "user", CAST(sum(n) AS BIGINT) AS followers FROM (
  SELECT dst AS k, 1 AS n FROM e UNION ALL SELECT p_partkey, 0 FROM part UNION ALL SELECT -p_partkey, 0 FROM part) GROUP BY k""")
def text_follower_count(spark, sf_dir):
    return combine.count_lines(lines(spark, sf_dir))


@query(f"""{EDGES} SELECT CAST(k AS VARCHAR) AS "user", count(*) AS followers FROM (
  SELECT dst AS k FROM e UNION ALL SELECT p_partkey FROM part UNION ALL SELECT -p_partkey FROM part) GROUP BY k""")
def text_line_count(spark, sf_dir):
    return combine.count_lines(lines(spark, sf_dir), "one")


@query(f"{EDGES} SELECT 'edge' AS kind, src AS a, dst AS b FROM e UNION ALL SELECT 'node', p_partkey, p_partkey FROM part")
def typed_lines(spark, sf_dir):
    """Edges and nodes parsed from text lines, some of which are malformed: no number, no end, or an empty line."""
    parts = t.read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))
    good = t.copurchase(spark, sf_dir).select(F.concat_ws(",", "src", "dst").alias("line")).union(parts)
    bad = [F.concat("id", F.lit(end)) for end in (",x", ",", "x", ",1.5")] + [F.concat(F.lit("x,"), "id"), F.lit("")]
    path = new_path(spark, "typed")
    good.union(parts.select(F.explode(F.array(*bad)))).write.text(path)
    read = readers.text_lines(spark, path)
    edges = readers.edges_of_lines(read).select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"))
    return edges.unionByName(readers.nodes_of_lines(read).select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.col("id").alias("b")))


for _name, _separator, _sql in (("tab", "\t", "chr(9)"), ("empty", "", "''")):

    @query(f"{EDGES} SELECT dst || {_sql} || count(*) AS line, CAST(1 AS BIGINT) AS files FROM e GROUP BY dst", f"one_file_{_name}")
    def _one_file(spark, sf_dir, separator=_separator):
        """Counts as one file of delimited lines, read again with the number of files that hold them."""
        path = new_path(spark, "one")
        sinks.write_delimited(combine.follower_count(t.copurchase(spark, sf_dir)), path, separator, one_file=True)
        files = spark.read.text(path).select(F.input_file_name().alias("file")).distinct().agg(F.count(F.lit(1)).alias("files"))
        return readers.text_lines(spark, path).crossJoin(F.broadcast(files))  # one row


@query("SELECT * FROM (VALUES ('aggregate', true), ('dataset', true), ('fold', true), ('group', false), ('reduce', true)) t(strategy, combined)")
def combining_plans(spark, sf_dir):
    """Which ways of combining sum before they shuffle, as their plans tell."""
    edges = t.copurchase(spark, sf_dir)
    plans = {s: introspect.plan_text(combine.follower_count(edges, s)) for s in combine.STRATEGIES}
    rows = [(s, "collect_list" not in plan and ("partial_sum" in plan or "partial_count" in plan)) for s, plan in plans.items()]
    return spark.createDataFrame(rows, "strategy string, combined boolean")


@query(f"{EDGES} SELECT src, dst FROM e")
def csv_edges(spark, sf_dir):
    """Edges written as CSV and read again with a schema, by a glob."""
    path = new_path(spark, "csv")
    sinks.write_csv(t.copurchase(spark, sf_dir), f"{path}/part-1")
    return readers.edges_csv(spark, f"{path}/part-*")


@query(f"{EDGES} SELECT '(' || dst || ',' || count(*) || ')' AS line FROM e GROUP BY dst")
def tuple_lines(spark, sf_dir):
    path = new_path(spark, "tuples")
    sinks.write_tuples(combine.follower_count(t.copurchase(spark, sf_dir)), path)
    return readers.text_lines(spark, path)


@query(f"""{EDGES} SELECT 'forward' AS tag, src, dst FROM e UNION ALL SELECT 'back', dst, src FROM e""")
def tagged_union(spark, sf_dir):
    edges = t.copurchase(spark, sf_dir)
    return readers.tagged(forward=edges, back=combine.reverse(edges)).select("tag", "src", "dst")


@query(f"WITH {t.MATRICES_SQL} SELECT 'A' AS src, i AS \"row\", k AS col, v AS val FROM a UNION ALL SELECT 'B', k, j, v FROM b")
def coo_cells(spark, sf_dir):
    """Both matrices as tagged cells in one folder of CSV files, read again."""
    a, b = t.matrices(spark, sf_dir)
    path = new_path(spark, "coo")
    cells = readers.tagged(A=a.select(F.col("i").alias("row"), F.col("k").alias("col"), F.col("v").alias("val")), B=b.select(F.col("k").alias("row"), F.col("j").alias("col"), F.col("v").alias("val")))
    sinks.write_csv(cells.select("row", "col", "val", "tag"), path)
    return readers.coo_csv(spark, path).select("src", "row", "col", "val")


@query(f"SELECT range AS src, CASE WHEN range % {K} = 0 THEN 0 ELSE range + 1 END AS dst FROM range(1, {K * K + 1})")
def chain_graph(spark, sf_dir):
    return generators.chain_graph(spark, K)


def _sparse_sql(rows: int, cols: int, density: float, seed: int) -> str:
    cells = rows * cols
    draw = generators.uniform_sql("cell", seed, 99)
    return f"""SELECT cell // {cols} AS "row", cell % {cols} AS col, {draw} + 1 AS val
  FROM (SELECT (range * {generators.cell_step(cells, seed)} + {seed}) % {cells} AS cell FROM range({round(cells * density)}))"""


@query(_sparse_sql(500, 400, 0.01, 7))
def gen_sparse(spark, sf_dir):
    return generators.sparse_matrix(spark, 500, 400, 0.01, seed=7)


@query(f"""WITH a AS ({_sparse_sql(300, 200, 0.02, 7)}), b AS ({_sparse_sql(200, 250, 0.02, 8)})
SELECT a."row" AS i, b.col AS j, CAST(sum(a.val * b.val) AS BIGINT) AS v FROM a JOIN b ON a.col = b."row" GROUP BY 1, 2""")
def gen_product(spark, sf_dir):
    """Two generated matrices and their product."""
    a = generators.sparse_matrix(spark, 300, 200, 0.02, seed=7).toDF("i", "k", "v")
    b = generators.sparse_matrix(spark, 200, 250, 0.02, seed=8).toDF("k", "j", "v")
    return matrix.multiply(a, b)


@query(f"""SELECT {generators.uniform_sql("range", 21, 499)} AS "row", {generators.uniform_sql("range", 22, 399)} AS col, {generators.uniform_sql("range", 23, 100)} AS val
FROM range(2000)""")
def gen_triples(spark, sf_dir):
    return generators.random_triples(spark, 500, 400, 0.01, seed=7)


DRAWN = generators.random_sources(5, 250, seed=3)


@query(f"""{EDGES},
r(source, node, dist) AS (
  SELECT DISTINCT src, src, 0 FROM e WHERE src IN ({", ".join(map(str, DRAWN))})
  UNION SELECT r.source, e.dst, r.dist + 1 FROM r JOIN e ON e.src = r.node WHERE r.dist < 12)
SELECT s AS source, coalesce(CAST(max(dist) AS DOUBLE), -1) AS eccentricity
FROM (SELECT DISTINCT s FROM (VALUES {", ".join(f"({x}::BIGINT)" for x in DRAWN)}) t(s)) LEFT JOIN (SELECT source, node, min(dist) AS dist FROM r GROUP BY ALL) ON source = s GROUP BY s""")
def random_sources_distances(spark, sf_dir):
    """Distances from five sources drawn by a seeded generator; some may be absent from the graph."""
    return shortest.eccentricity(shortest.distances(t.copurchase(spark, sf_dir), DRAWN), DRAWN, unreached=-1.0)


# --- follower counts

COUNT_SQL = f'{EDGES} SELECT dst AS "user", count(*) AS followers FROM e GROUP BY dst'


@query(COUNT_SQL)
def follower_count(spark, sf_dir):
    return combine.follower_count(t.copurchase(spark, sf_dir))


for _strategy in combine.STRATEGIES:
    query(COUNT_SQL, f"combine_{_strategy}")(lambda spark, sf_dir, s=_strategy: combine.follower_count(t.copurchase(spark, sf_dir), s))


@query("""SELECT p_partkey AS "user", count(l_partkey) AS followers
FROM part LEFT JOIN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) ON l_partkey = p_partkey GROUP BY p_partkey""")
def follower_count_zero_fill(spark, sf_dir):
    nodes, edges = t.large_orders(spark, sf_dir)
    return combine.follower_count(edges, "reduce", nodes)


@query(f"{EDGES} SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS neighbours FROM e GROUP BY src")
def adjacency_list(spark, sf_dir):
    found = combine.adjacency(t.copurchase(spark, sf_dir))
    return found.select("node", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(f"{EDGES} SELECT src AS node FROM e UNION SELECT dst FROM e")
def vertices(spark, sf_dir):
    return combine.vertices(t.copurchase(spark, sf_dir))


@query(f"{BAG} SELECT DISTINCT src AS node FROM e")
def distinct_sources(spark, sf_dir):
    return combine.sources_of(t.user_sequence(spark, sf_dir))


@query(f"{EDGES} SELECT src, dst FROM e WHERE src <= {BOUND} AND dst <= {BOUND}")
def filter_max_id(spark, sf_dir):
    return combine.max_id(t.copurchase(spark, sf_dir), BOUND)


@query(f"{EDGES} SELECT dst AS src, src AS dst FROM e")
def reverse_edges(spark, sf_dir):
    return combine.reverse(t.copurchase(spark, sf_dir))


# --- paths and triangles

PATH2_SQL = "SELECT CAST(count(*) AS BIGINT) AS paths FROM e a JOIN e b ON a.dst = b.src"


@query(f"{EDGES} {PATH2_SQL}")
def path2_count(spark, sf_dir):
    return paths.path2_count(t.copurchase(spark, sf_dir))


@query(f"{EDGES} {PATH2_SQL}")
def path2_count_broadcast(spark, sf_dir):
    return paths.path2_count(t.copurchase(spark, sf_dir), "broadcast")


@query(f"{BAG} {PATH2_SQL}")
def path2_count_bag(spark, sf_dir):
    return paths.path2_count(t.user_sequence(spark, sf_dir))


@query(f"{EDGES} SELECT a.src, b.dst, count(*) AS paths FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst GROUP BY 1, 2")
def path2_edges(spark, sf_dir):
    return paths.path2_edges(t.copurchase(spark, sf_dir))


def _closed(where: str) -> str:
    return f"""SELECT closed_paths, closed_paths // 3 AS triangles FROM (
  SELECT CAST(count(*) AS BIGINT) AS closed_paths FROM e a JOIN e b ON a.dst = b.src JOIN e c ON c.src = b.dst AND c.dst = a.src {where})"""


for _strategy in paths.STRATEGIES:
    query(f"{EDGES} {_closed('WHERE a.src <> b.dst')}", f"triangles_{_strategy}")(lambda spark, sf_dir, s=_strategy: paths.triangles(t.copurchase(spark, sf_dir), s))
    # Here edges repeat and lead back to where they start.
    query(f"{BAG} {_closed('WHERE a.src <> b.dst')}", f"triangles_bag_{_strategy}")(lambda spark, sf_dir, s=_strategy: paths.triangles(t.user_sequence(spark, sf_dir), s))


@query(f"{BAG} {_closed('')}")
def triangles_bag_return(spark, sf_dir):
    return paths.triangles(t.user_sequence(spark, sf_dir), exclude_return=False)


@query(f"WITH e AS (SELECT DISTINCT src, dst FROM ({t.USER_SEQUENCE_SQL})) {_closed('WHERE a.src <> b.dst')}")
def triangles_distinct(spark, sf_dir):
    return paths.triangles(t.user_sequence(spark, sf_dir), distinct=True)


@query(f"WITH e AS (SELECT * FROM ({t.COPURCHASE_SQL}) WHERE src <= {BOUND} AND dst <= {BOUND}) {_closed('WHERE a.src <> b.dst')}")
def triangles_max_id(spark, sf_dir):
    return paths.triangles(combine.max_id(t.copurchase(spark, sf_dir), BOUND))


# --- PageRank


def _pagerank_sql(edges: str, ranks: str, n: str, rounds: int, damping: float = 1.0) -> str:
    parts = [f"WITH g AS MATERIALIZED ({edges})", "f AS MATERIALIZED (SELECT src, dst, count(*) OVER (PARTITION BY src) AS fan FROM g)", f"r0 AS MATERIALIZED ({ranks})", f"c AS ({n})"]
    for i in range(1, rounds + 1):
        parts.append(f"""
s{i} AS MATERIALIZED (SELECT r.node, coalesce(sum(o."rank" / fan), 0) AS got FROM r0 r LEFT JOIN f ON f.dst = r.node LEFT JOIN r{i - 1} o ON o.node = f.src GROUP BY r.node),
r{i} AS MATERIALIZED (SELECT node, CASE WHEN node = 0 THEN got ELSE
  {damping} * (got + (SELECT sum(got) FROM s{i} WHERE node = 0) / (SELECT n FROM c)) + {1.0 - damping} / (SELECT n FROM c) END AS "rank" FROM s{i})""")
    return ",\n".join(parts)


CHAIN_EDGES = f"SELECT range AS src, CASE WHEN range % {K} = 0 THEN 0 ELSE range + 1 END AS dst FROM range(1, {K * K + 1})"
CHAIN_RANKS = f'SELECT range AS node, CASE WHEN range = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / {K * K} END AS "rank" FROM range(0, {K * K + 1})'


def _chain_sql(rounds: int) -> str:
    return _pagerank_sql(CHAIN_EDGES, CHAIN_RANKS, f"SELECT {K * K} AS n", rounds)


def _chain(spark: SparkSession, rounds: int = 10):
    return pagerank.pagerank(generators.chain_graph(spark, K), generators.chain_ranks(spark, K), rounds)


def rounded():
    return F.round("rank", 12).alias("rank")


@query(f'{_chain_sql(10)} SELECT node, round("rank", 12) AS "rank" FROM r10', "pagerank")
def _pagerank(spark, sf_dir):
    return _chain(spark)[0].select("node", rounded())


@query(f'{_chain_sql(1)} SELECT node, round("rank", 12) AS "rank" FROM r1')
def pagerank_step(spark, sf_dir):
    edges = pagerank.with_fan(generators.chain_graph(spark, K))
    return pagerank.step(edges, generators.chain_ranks(spark, K), K * K).select("node", rounded())


@query(f'{_chain_sql(10)} ' + " UNION ALL ".join(f'SELECT CAST({i} AS INTEGER) AS iteration, round(sum("rank"), 9) AS mass FROM r{i} WHERE node <> 0' for i in range(1, 11)))
def pagerank_mass(spark, sf_dir):
    return _chain(spark)[1].select("iteration", F.round("mass", 9).alias("mass"))


@query(f'{_chain_sql(10)} SELECT node, round("rank", 12) AS "rank" FROM r10 WHERE node <= 100')
def pagerank_first101(spark, sf_dir):
    return pagerank.first(_chain(spark)[0]).select("node", rounded())


@query(
    _pagerank_sql(
        f"SELECT src + 1 AS src, dst + 1 AS dst FROM ({t.COPURCHASE_SQL})",
        'SELECT node, CASE WHEN node = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (SELECT count(DISTINCT v) FROM (SELECT src AS v FROM g UNION ALL SELECT dst FROM g)) END AS "rank" '
        "FROM (SELECT src AS node FROM g UNION SELECT dst FROM g UNION SELECT 0)",
        "SELECT count(*) AS n FROM r0 WHERE node <> 0", 10, 0.85,
    )
    + ' SELECT node, round("rank", 10) AS "rank" FROM r10'
)
def pagerank_graph(spark, sf_dir):
    """A general graph: ranks divided by out-degree, ends without edges lead to the sink, damping 0.85. Ids are raised by
    one, as 0 is the sink's."""
    raised = t.copurchase(spark, sf_dir).select((F.col("src") + 1).alias("src"), (F.col("dst") + 1).alias("dst"))
    edges = materialise(pagerank.sunk(raised), "edges")
    nodes = combine.vertices(edges).where(F.col("node") != generators.SINK)
    n = nodes.count()
    sink = spark.range(1).select(F.col("id").alias("node"), F.lit(0.0).alias("rank"))
    ranks = nodes.select("node", F.lit(1.0 / n).alias("rank")).unionByName(sink)
    return pagerank.pagerank(edges, ranks, 10, 0.85)[0].select("node", F.round("rank", 10).alias("rank"))


# --- shortest paths

REACHED = f"""{EDGES},
r(source, node, dist) AS (
  SELECT DISTINCT src, src, 0 FROM e WHERE src IN (1, 2)
  UNION SELECT r.source, e.dst, r.dist + 1 FROM r JOIN e ON e.src = r.node WHERE r.dist < 12),
d AS (SELECT source, node, CAST(min(dist) AS INTEGER) AS dist FROM r GROUP BY source, node)"""


@query(f"{REACHED} SELECT source, node, dist FROM d")
def ssp_distances(spark, sf_dir):
    return shortest.distances(t.copurchase(spark, sf_dir), SOURCES)


@query(f"{REACHED} SELECT source, node, dist FROM d WHERE dist = 1")
def ssp_round(spark, sf_dir):
    """One hop from the sources; a source that is reached again is left out."""
    edges = t.copurchase(spark, sf_dir)
    begin = shortest.start(edges, SOURCES)
    return shortest.relax(edges, begin).join(begin, ["source", "node"], "left_anti").select("source", "node", "dist")


@query(f"{REACHED} SELECT source, node, dist FROM d WHERE dist <= 3")
def ssp_three_rounds(spark, sf_dir):
    return shortest.distances(t.copurchase(spark, sf_dir), SOURCES, max_iter=3)


@query(f"{REACHED} SELECT source, CAST(max(dist) AS INTEGER) AS eccentricity FROM d GROUP BY source")
def ssp_eccentricity(spark, sf_dir):
    return shortest.eccentricity(shortest.distances(t.copurchase(spark, sf_dir), SOURCES))


@query(f"""{REACHED} SELECT s AS source, coalesce(CAST(max(dist) AS DOUBLE), -1) AS eccentricity
FROM (VALUES (1::BIGINT), (2), (-7)) t(s) LEFT JOIN d ON d.source = s GROUP BY s""")
def ssp_unreached(spark, sf_dir):
    asked = [*SOURCES, -7]
    return shortest.eccentricity(shortest.distances(t.copurchase(spark, sf_dir), asked), asked, unreached=-1.0)


@query(f"{REACHED} SELECT node, min(dist) FILTER (source = 1) AS d_1, min(dist) FILTER (source = 2) AS d_2 FROM d GROUP BY node")
def ssp_by_source(spark, sf_dir):
    return shortest.by_source(shortest.distances(t.copurchase(spark, sf_dir), SOURCES), SOURCES)


@query(f"""{REACHED},
a AS (SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS l FROM e GROUP BY src),
m AS (SELECT node, string_agg('"' || source || '":' || dist, ',' ORDER BY source) AS k FROM d GROUP BY node),
v AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
SELECT '{{"nodeId":' || v.node || ',"adjList":[' || coalesce(l, '') || '],"isObj":' || (v.node IN (1, 2))::VARCHAR || ',"isActive":false,"kMap":{{' || coalesce(k, '') || '}}}}' AS line
FROM v LEFT JOIN a USING (node) LEFT JOIN m USING (node)""")
def node_json_roundtrip(spark, sf_dir):
    """Vertex states written as JSON lines, read, and serialised once more."""
    edges = t.copurchase(spark, sf_dir)
    states = shortest.node_states(edges, shortest.distances(edges, SOURCES), SOURCES)
    path = new_path(spark, "nodes")
    sinks.write_node_json(states, path)
    return sinks.node_json(readers.node_states(readers.text_lines(spark, path)))


# --- k-means


def _kmeans_sql(rounds: int) -> str:
    seeds = ", ".join(f"({s}::DOUBLE)" for s in kmeans.SEEDS)
    parts = [f"{EDGES}, h AS MATERIALIZED (SELECT x, count(*) AS n FROM (SELECT count(*) AS x FROM e GROUP BY dst) GROUP BY x)", f"c0 AS (SELECT * FROM (VALUES {seeds}) t(c))", "moved0 AS (SELECT true AS m)"]
    for i in range(1, rounds + 1):
        parts.append(f"""
a{i} AS (SELECT x, n, (SELECT arg_min(c, struct_pack(d := abs(x - c), c := c)) FROM c{i - 1}) AS old FROM h),
n{i} AS MATERIALIZED (SELECT old, sum(n) AS n, sum(n * x) AS sx, sum(n * x * x) AS sxx FROM a{i} GROUP BY old),
k{i} AS MATERIALIZED (SELECT old, CAST(sx AS DOUBLE) / CAST(n AS DOUBLE) AS c, CAST(n AS BIGINT) AS n, CAST(sxx AS DOUBLE) - 2 * old * CAST(sx AS DOUBLE) + old * old * CAST(n AS DOUBLE) AS sse FROM n{i}),
moved{i} AS MATERIALIZED (SELECT (SELECT m FROM moved{i - 1}) AND bool_or(abs(c - old) > {kmeans.TOLERANCE}) AS m FROM k{i}),
c{i} AS MATERIALIZED (SELECT c FROM k{i} WHERE (SELECT m FROM moved{i - 1}) UNION ALL SELECT c FROM c{i - 1} WHERE NOT (SELECT m FROM moved{i - 1}))""")
    return ",\n".join(parts)


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.histogram(combine.follower_count(t.copurchase(spark, sf_dir)))


@query(f"{_kmeans_sql(10)} SELECT round(c, 9) AS centroid FROM c10", "kmeans")
def _kmeans(spark, sf_dir):
    return kmeans.kmeans(_histogram(spark, sf_dir))[0].select(F.round("centroid", 9).alias("centroid"))


@query(f"{_kmeans_sql(1)} SELECT old, round(c, 9) AS centroid, n, round(sse, 6) AS sse FROM k1")
def kmeans_step(spark, sf_dir):
    return kmeans.step(_histogram(spark, sf_dir), list(kmeans.SEEDS)).select("old", F.round("centroid", 9).alias("centroid"), "n", F.round("sse", 6).alias("sse"))


@query(f"{_kmeans_sql(10)} " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS iteration, round(c, 9) AS centroid, n, round(sse, 6) AS sse FROM k{i} WHERE (SELECT m FROM moved{i - 1})" for i in range(1, 11)))
def kmeans_history(spark, sf_dir):
    return kmeans.kmeans(_histogram(spark, sf_dir))[1].select("iteration", F.round("centroid", 9).alias("centroid"), "n", F.round("sse", 6).alias("sse"))


# --- matrices

PRODUCT_SQL = f"WITH {t.MATRICES_SQL} SELECT i, j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM a JOIN b USING (k) GROUP BY i, j"

for _strategy in matrix.STRATEGIES:
    query(PRODUCT_SQL, f"matmul_{_strategy}")(lambda spark, sf_dir, s=_strategy: matrix.multiply(*t.matrices(spark, sf_dir), s, t.SIZES))


@query(f"""WITH {t.MATRICES_SQL}, z AS (SELECT i, k, CASE WHEN k % 2 = 0 THEN 0 ELSE v END AS v FROM a)
SELECT i, j, CAST(sum(z.v * b.v) AS BIGINT) AS v FROM z JOIN b USING (k) GROUP BY i, j HAVING sum(z.v * b.v) <> 0""")
def matmul_drop_zeros(spark, sf_dir):
    a, b = t.matrices(spark, sf_dir)
    return matrix.multiply(a.withColumn("v", F.when(F.col("k") % 2 == 0, 0).otherwise(F.col("v"))), b, "coo", drop_zeros=True)


@query(f"WITH {t.MATRICES_SQL} SELECT i, k, v, CAST(i // 29 AS INTEGER) AS block_row, CAST(k // 50 AS INTEGER) AS block_col FROM a")
def block_coords(spark, sf_dir):
    """Seven block rows over 200 do not divide evenly."""
    return matrix.block_coordinates(t.matrices(spark, sf_dir)[0], "i", "k", t.SIZES[:2], (7, 4))
