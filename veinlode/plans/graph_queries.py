"""Queries of the graph operators, on the module graph of one or two snapshot years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as g
from ..sources.store import table
from . import views as v
from .registry import query

E = v.EDGES
D = "CAST({} AS DOUBLE)"


@query(f"""WITH {E}, {v.sql_edges('e', 1995)}
SELECT s_suppkey AS module, coalesce(i.n, 0) AS ca, coalesce(o.n, 0) AS ce, coalesce(i.n, 0) + coalesce(o.n, 0) AS total
FROM supplier LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) i ON i.dst = s_suppkey
LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY src) o ON o.src = s_suppkey""")
def gr04_module_coupling(spark: SparkSession, d: str) -> DataFrame:
    return g.coupling(v.modules(spark, d), v.plain(spark, d, 1995))


@query(f"""WITH {E}, p AS (SELECT src, dst, relation FROM edges WHERE year = 1995),
o AS (SELECT s_suppkey AS node, s_nationkey AS module FROM supplier)
SELECT DISTINCT a.module AS src, b.module AS dst FROM p JOIN o a ON a.node = src JOIN o b ON b.node = dst
WHERE relation IN ('AF', 'RF', 'NO') AND a.module <> b.module""")
def gr02_project_modules(spark: SparkSession, d: str) -> DataFrame:
    owner = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("module"))
    return g.project(v.edges(spark, d, 1995), owner, ["AF", "RF", "NO"])


@query(f"""WITH {E}, p AS (SELECT src, dst, relation FROM edges WHERE year = 1995),
o AS (SELECT s_suppkey AS node, s_nationkey AS module FROM supplier)
SELECT DISTINCT a.module AS src, b.module AS dst FROM p JOIN o a ON a.node = src JOIN o b ON b.node = dst WHERE relation = 'NO'""")
def gr03_import_adjacency(spark: SparkSession, d: str) -> DataFrame:
    owner = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("module"))
    return g.project(v.edges(spark, d, 1995), owner, ["NO"], loops=True)


@query(f"""WITH {E}, {v.sql_edges('e', 1995)}, n AS (SELECT count(*) AS n FROM supplier), o AS (SELECT count(*) AS c FROM e GROUP BY src),
m AS (SELECT coalesce(sum(c), 0)::BIGINT AS m, coalesce(max(c), 0) AS most FROM o)
SELECT n, m, CASE WHEN n > 1 THEN m / (n * (n - 1))::DOUBLE ELSE 0 END AS density, coalesce(2.0::DOUBLE * m / nullif(n, 0), 0) AS mean_coupling,
       coalesce(m / nullif(n, 0)::DOUBLE, 0) AS mean_out, CASE WHEN n > 1 THEN most / (n - 1)::DOUBLE ELSE 0 END AS max_out FROM n, m""")
def gr07_density(spark: SparkSession, d: str) -> DataFrame:
    return g.density(v.modules(spark, d), v.plain(spark, d, 1995))


@query(f"""WITH {E}, {v.sql_edges('e', 1995)}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
k AS (SELECT a, count(*) AS k FROM u GROUP BY a),
t AS (SELECT x.a, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY x.a)
SELECT s_suppkey AS module, coalesce(k, 0) AS degree, coalesce(t, 0) AS triangles,
       CASE WHEN k > 1 THEN round(2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)), 6) ELSE 0 END AS clustering
FROM supplier LEFT JOIN k ON k.a = s_suppkey LEFT JOIN t ON t.a = s_suppkey""")
def gr08_clustering(spark: SparkSession, d: str) -> DataFrame:
    return g.clustering(v.modules(spark, d), v.plain(spark, d, 1995)).withColumn("clustering", F.round("clustering", 6))


@query(f"""WITH {E}, {v.sql_edges('e', 1995)}, d AS (SELECT src AS x FROM e UNION ALL SELECT dst FROM e), k AS (SELECT count(*) AS k FROM d GROUP BY x),
s AS (SELECT sum(k)::DOUBLE AS s FROM k)
SELECT coalesce(round((SELECT -sum(k / s * log2(k / s)) FROM k, s) / log2((SELECT count(*) FROM supplier)), 6), 0) AS entropy""")
def gr09_degree_entropy(spark: SparkSession, d: str) -> DataFrame:
    return g.degree_entropy(v.modules(spark, d), v.plain(spark, d, 1995)).select(F.round("entropy", 6).alias("entropy"))


CYCLIC = """SELECT a AS module, min(b) AS component FROM (
    SELECT r.a, r.b FROM reach r JOIN reach q ON r.a = q.b AND r.b = q.a) GROUP BY a"""


@query(f"""WITH RECURSIVE {E}, {v.sql_edges('e', 1995)},
reach AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON e.src = r.b) {CYCLIC}""")
def gr05_cyclic_modules(spark: SparkSession, d: str) -> DataFrame:
    return g.cyclic(v.plain(spark, d, 1995))


@query(f"""WITH RECURSIVE {E}, e AS (SELECT DISTINCT src, dst, year FROM edges),
reach AS (SELECT year, src AS a, dst AS b FROM e UNION SELECT r.year, r.a, e.dst FROM reach r JOIN e ON e.src = r.b AND e.year = r.year)
SELECT year, a AS module, min(b) AS component FROM (
    SELECT r.year, r.a, r.b FROM reach r JOIN reach q ON r.a = q.b AND r.b = q.a AND r.year = q.year) GROUP BY year, a""")
def gr05_cyclic_by_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return g.cyclic_per_graph(v.edges(spark, d).select("year", "src", "dst").distinct(), "year")


@query(f"""WITH {E}, {v.sql_edges('a', 1995)}, {v.sql_edges('b', 1996)},
k AS (SELECT (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) AS added,
             (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) AS removed,
             (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS kept)
SELECT added, removed, kept, coalesce((added + removed)::DOUBLE / nullif(added + removed + kept, 0), 0) AS distance FROM k""")
def gr12_graph_change(spark: SparkSession, d: str) -> DataFrame:
    return g.graph_change(v.plain(spark, d, 1995), v.plain(spark, d, 1996), ["src", "dst"])


@query(f"""WITH {E}, {v.sql_edges('a', 1995)}, {v.sql_edges('b', 1996)},
nodes AS (SELECT src AS module FROM b UNION SELECT dst FROM b), old AS (SELECT src AS module FROM a UNION SELECT dst FROM a),
gained AS (SELECT src, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY src),
lost AS (SELECT src, count(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY src)
SELECT module, module NOT IN (SELECT module FROM old) AS is_new, coalesce(gained.n, 0) AS gained, coalesce(lost.n, 0) AS lost
FROM nodes LEFT JOIN gained ON gained.src = module LEFT JOIN lost ON lost.src = module""")
def gr13_node_delta(spark: SparkSession, d: str) -> DataFrame:
    a, b = v.plain(spark, d, 1995), v.plain(spark, d, 1996)
    ends = lambda e: e.select(F.explode(F.array("src", "dst")).alias("module")).distinct()
    return g.node_delta(a, b, ends(a), ends(b))


TOUCHED = "touched AS (SELECT DISTINCT l_suppkey AS node FROM lineitem JOIN (SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1995 ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) ON o_orderkey = l_orderkey)"


def touched(spark: SparkSession, d: str) -> DataFrame:
    big = table(spark, d, "orders").where(F.year("o_orderdate") == 1995).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(3)
    lines = table(spark, d, "lineitem").join(F.broadcast(big.select(F.col("o_orderkey").alias("l_orderkey"))), "l_orderkey")  # three rows
    return lines.select(F.col("l_suppkey").alias("node")).distinct()


@query(f"""WITH RECURSIVE {E}, {v.sql_edges('e', 1995)}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), {TOUCHED},
r AS (SELECT node, 0 AS hop FROM touched UNION SELECT u.b, hop + 1 FROM r JOIN u ON u.a = r.node WHERE hop < 3)
SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY node""")
def gr14_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    return g.reach(v.plain(spark, d, 1995), touched(spark, d), 3)


@query(f"""WITH {E}, {v.sql_edges('e', 1995)}, {TOUCHED}
SELECT node FROM touched UNION SELECT e.dst FROM e JOIN touched ON e.src = node UNION SELECT e.src FROM e JOIN touched ON e.dst = node""")
def gr15_one_hop(spark: SparkSession, d: str) -> DataFrame:
    return g.reach(v.plain(spark, d, 1995), touched(spark, d), 1).select("node")


@query(f"""WITH {E}, {v.sql_edges('e', 1995)}, {TOUCHED} SELECT src, dst FROM e WHERE src IN (SELECT node FROM touched) AND dst IN (SELECT node FROM touched)""")
def gr16_induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    t = touched(spark, d)
    e = v.plain(spark, d, 1995)
    return e.join(t.withColumnRenamed("node", "src"), "src", "left_semi").join(t.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


@query("""SELECT l_returnflag AS kind, s_suppkey AS node, row_number() OVER (PARTITION BY l_returnflag ORDER BY s_suppkey) - 1 AS place
FROM (SELECT DISTINCT l_returnflag, l_suppkey AS s_suppkey FROM lineitem WHERE l_quantity >= 46)""")
def gr17_dense_indices(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    nodes = table(spark, d, "lineitem").where("l_quantity >= 46").select(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("node")).distinct()
    place = F.row_number().over(Window.partitionBy("kind").orderBy("node")) - 1
    return nodes.withColumn("place", place.cast("long"))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS sha, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent FROM orders),
c AS (SELECT sha, parent AS ancestor FROM p WHERE parent IS NOT NULL UNION SELECT c.sha, p.parent FROM c JOIN p ON p.sha = c.ancestor WHERE p.parent IS NOT NULL)
SELECT sha, count(*) AS ancestors, min(ancestor) AS least FROM c GROUP BY sha""")
def gr19_ancestry(spark: SparkSession, d: str) -> DataFrame:
    return g.chain_facts(parents(spark, d)).select("sha", F.col("depth").alias("ancestors"), "least")


def parents(spark: SparkSession, d: str) -> DataFrame:
    """A customer's orders as a line of commits, each with the one before it."""
    from pyspark.sql.window import Window

    chain = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.lag("o_orderkey").over(chain).alias("parent")).where("parent IS NOT NULL")


@query(f"""WITH {E} SELECT relation, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM edges WHERE year = 1995 GROUP BY relation""")
def gr10_relation_counts(spark: SparkSession, d: str) -> DataFrame:
    e = v.edges(spark, d, 1995)
    return e.groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def metric_row(spark: SparkSession, d: str, year: int) -> DataFrame:
    return g.density(v.modules(spark, d), v.plain(spark, d, year))


@query("WITH " + E + ", " + ", ".join(f"m{y} AS (SELECT count(*)::DOUBLE AS m FROM (SELECT DISTINCT src, dst FROM edges WHERE year = {y}))" for y in (1995, 1996)) + """,
n AS (SELECT count(*)::DOUBLE AS n FROM supplier)
SELECT 'density' AS metric, round(m1995.m / (n * (n - 1)), 9) AS before, round(m1996.m / (n * (n - 1)), 9) AS after, round((m1996.m - m1995.m) / (n * (n - 1)), 9) AS delta FROM m1995, m1996, n
UNION ALL SELECT 'mean_coupling', round(2 * m1995.m / n, 9), round(2 * m1996.m / n, 9), round(2 * (m1996.m - m1995.m) / n, 9) FROM m1995, m1996, n""")
def gr11_compare_metrics(spark: SparkSession, d: str) -> DataFrame:
    names = ["density", "mean_coupling"]
    long = lambda y, name: metric_row(spark, d, y).select(*names).unpivot([], names, "metric", name)
    both = long(1995, "before").join(long(1996, "after"), "metric").withColumn("delta", F.col("after") - F.col("before"))
    return both.select("metric", *[F.round(c, 9).alias(c) for c in ("before", "after", "delta")])


@query(f"""WITH {E}, {v.sql_edges('e', 1995)} SELECT x.src AS a, x.dst AS b FROM e x JOIN e y ON x.src = y.dst AND x.dst = y.src WHERE x.src < x.dst""")
def jn11_mutual_imports(spark: SparkSession, d: str) -> DataFrame:
    e = v.plain(spark, d, 1995)
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return e.join(back, ["src", "dst"], "left_semi").where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"))


CYCLES = """ra AS (SELECT src AS x, dst AS y FROM a UNION SELECT r.x, a.dst FROM ra r JOIN a ON a.src = r.y),
rb AS (SELECT src AS x, dst AS y FROM b UNION SELECT r.x, b.dst FROM rb r JOIN b ON b.src = r.y),
ca AS (SELECT r.x AS m, min(r.y) AS c FROM ra r JOIN ra q ON r.x = q.y AND r.y = q.x GROUP BY 1), cb AS (SELECT r.x AS m, min(r.y) AS c FROM rb r JOIN rb q ON r.x = q.y AND r.y = q.x GROUP BY 1)"""
ALL_TOUCHED = "t AS (SELECT DISTINCT l_orderkey AS sample, l_suppkey AS m FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE year(o_orderdate) = 1995)"


def all_touched(spark: SparkSession, d: str) -> DataFrame:
    """(sample, module) of every order of 1995."""
    of_year = table(spark, d, "orders").where(F.year("o_orderdate") == 1995).select(F.col("o_orderkey").alias("sample"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.col("l_suppkey").alias("module")).join(of_year, "sample", "left_semi").distinct()


def snapshot(spark: SparkSession, d: str, year: int) -> DataFrame:
    """(snap, module, ca, ce, in_cycle) of the modules with an edge in that year."""
    e = v.plain(spark, d, year)
    ends = e.select(F.explode(F.array("src", "dst")).alias("module")).distinct()
    on = g.cyclic(e).select("module", F.lit(True).alias("_c"))
    return g.coupling(ends, e).join(on, "module", "left").select(F.lit("s").alias("snap"), "module", "ca", "ce", F.coalesce("_c", F.lit(False)).alias("in_cycle"))


@query(f"""WITH RECURSIVE {E}, {v.sql_edges('a', 1995)}, {v.sql_edges('b', 1996)}, {CYCLES}, {ALL_TOUCHED},
d1 AS (SELECT m, count(*) AS k FROM (SELECT src AS m FROM a UNION ALL SELECT dst FROM a) GROUP BY m), d2 AS (SELECT m, count(*) AS k FROM (SELECT src AS m FROM b UNION ALL SELECT dst FROM b) GROUP BY m),
w AS (SELECT (SELECT avg(k) FROM d2) - (SELECT avg(k) FROM d1) AS trend),
x AS (SELECT sample, avg(d2.k - d1.k) FILTER (d1.k IS NOT NULL AND d2.k IS NOT NULL) AS growth, count(*) FILTER (d1.k IS NOT NULL AND d2.k IS NOT NULL AND t.m IN (SELECT m FROM cb) AND t.m NOT IN (SELECT m FROM ca)) AS joined
      FROM t LEFT JOIN d1 ON d1.m = t.m LEFT JOIN d2 ON d2.m = t.m GROUP BY 1),
y AS (SELECT *, CASE WHEN growth IS NULL THEN 'touched_modules_missing_in_future' WHEN joined > 0 THEN 'joined_new_cycle' WHEN growth - trend > 0.5 THEN 'excess_coupling_growth' ELSE 'no_degradation' END AS reason FROM x, w)
SELECT sample, round(growth, 6) AS growth, round(CASE WHEN growth IS NOT NULL THEN trend END, 6) AS trend, round(growth - trend, 6) AS excess, joined, reason,
CASE reason WHEN 'touched_modules_missing_in_future' THEN NULL WHEN 'no_degradation' THEN 0 ELSE 1 END AS label FROM y""")
def lb01_future_coupling_label(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.labels import future_coupling

    out = future_coupling(snapshot(spark, d, 1995), snapshot(spark, d, 1996), all_touched(spark, d).withColumn("snap", F.lit("s")), 0.5)
    return out.select("sample", *[F.round(c, 6).alias(c) for c in ("growth", "trend", "excess")], "joined", "reason", "label")


@query(f"""WITH RECURSIVE {E}, {v.sql_edges('a', 1995)}, {v.sql_edges('b', 1996)}, {CYCLES}, {TOUCHED},
sa AS (SELECT list(m ORDER BY m) AS members FROM ca GROUP BY c), sb AS (SELECT c, list(m ORDER BY m) AS members FROM cb GROUP BY c)
SELECT c AS component, array_to_string(members, ',') AS members FROM sb WHERE members NOT IN (FROM sa) AND c IN (SELECT c FROM cb JOIN touched ON node = m)""")
def lb02_new_cycles(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.labels import new_cycles

    before, after = (g.cyclic(v.plain(spark, d, y)) for y in (1995, 1996))
    out = new_cycles(before, after, touched(spark, d).withColumnRenamed("node", "module"))
    return out.select("component", F.concat_ws(",", F.transform("members", lambda m: m.cast("string"))).alias("members"))


def nested(spark: SparkSession, d: str) -> DataFrame:
    """Symbols: a supplier is a module, its even line items are methods of the odd ones, which are classes of it."""
    lines = table(spark, d, "lineitem").where("l_linenumber <= 4").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    name = F.concat_ws(":", "l_orderkey", "l_linenumber")
    up = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("m"), F.col("s").cast("string"))).otherwise(F.concat_ws(":", "l_orderkey", (F.col("l_linenumber") - 1).cast("string")))
    inner = lines.select(name.alias("id"), up.alias("parent_id"), F.lit("function").alias("type"), name.alias("qualified_name"))
    mods = table(spark, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit("module").alias("type"), F.concat(F.lit("pkg."), F.col("s_suppkey").cast("string")).alias("qualified_name"))
    return mods.union(inner)


@query("""WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_suppkey) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
r AS (SELECT o, n, 'pkg.' || s AS module FROM l WHERE n = 1 UNION ALL SELECT l.o, l.n, r.module FROM r JOIN l ON l.o = r.o AND l.n = r.n + 1)
SELECT l.o || ':' || l.n AS id, module FROM l LEFT JOIN r ON r.o = l.o AND r.n = l.n UNION ALL SELECT 'm' || s_suppkey, 'pkg.' || s_suppkey FROM supplier""")
def gr01_owning_modules(spark: SparkSession, d: str) -> DataFrame:
    return g.owning_modules(nested(spark, d))


@query("""SELECT p_partkey AS module FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount >= 0.1)""")
def gr06_touched_modules(spark: SparkSession, d: str) -> DataFrame:
    modules = table(spark, d, "part").select(F.col("p_partkey").alias("module"), F.concat(F.lit("src\\m"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"))
    changed = table(spark, d, "lineitem").where("l_discount >= 0.1").select(F.concat(F.lit("src/m"), F.col("l_partkey").cast("string"), F.lit(".py")).alias("path"))
    return g.touched_modules(modules, changed)


@query("""WITH i AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey < 12) SELECT DISTINCT l_partkey AS src, CASE WHEN l_suppkey IN (FROM i) THEN 'init' || l_suppkey ELSE 'c' || l_suppkey END AS dst FROM lineitem""")
def gr22_constructor_calls(spark: SparkSession, d: str) -> DataFrame:
    cls = lambda c: F.concat(F.lit("c"), F.col(c).cast("string"))
    calls = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), cls("l_suppkey").alias("dst"))
    s = table(spark, d, "supplier")
    inits = s.where("s_nationkey < 12").select(F.concat(F.lit("init"), F.col("s_suppkey").cast("string")).alias("id"), F.lit("__init__").alias("name"), cls("s_suppkey").alias("parent_id"))
    return g.constructor_edges(calls, inits)


NAMED = """n AS (SELECT s_suppkey AS k, CASE s_nationkey % 3 WHEN 0 THEN 'pkg.m' || s_suppkey WHEN 1 THEN 'pkg.s' || s_nationkey || '.__init__' ELSE 'pkgs.m' || s_suppkey END AS name FROM supplier)"""


def named_edges(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey")
    name = F.when(n % 3 == 0, F.concat(F.lit("pkg.m"), k)).when(n % 3 == 1, F.concat(F.lit("pkg.s"), n.cast("string"), F.lit(".__init__"))).otherwise(F.concat(F.lit("pkgs.m"), k))
    names = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), name.alias("name"))
    e = v.plain(spark, d, 1995)
    for end in ("src", "dst"):
        e = e.join(names.select(F.col("k").alias(end), F.col("name").alias(f"_{end}")), end)
    return e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


@query(f"""WITH {E}, {v.sql_edges('e', 1995)}, {NAMED}, x AS (SELECT regexp_replace(a.name, '\\.__init__$', '') AS src, regexp_replace(b.name, '\\.__init__$', '') AS dst FROM e JOIN n a ON a.k = src JOIN n b ON b.k = dst)
SELECT DISTINCT src, dst FROM x WHERE src LIKE 'pkg.%' AND dst LIKE 'pkg.%' AND src <> dst""")
def gr23_internal_imports(spark: SparkSession, d: str) -> DataFrame:
    return g.internal_edges(named_edges(spark, d), "pkg")


@query(f"""WITH {E}, {v.sql_edges('a', 1995)}, {v.sql_edges('b', 1996)}, m AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey < 20),
x AS (SELECT *, 'ours' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'theirs' FROM (FROM b EXCEPT FROM a))
SELECT src, dst, side, CASE WHEN NOT (src IN (FROM m) AND dst IN (FROM m)) THEN 'unknown module' WHEN side = 'ours' AND src % 2 = 0 THEN 'conditional' ELSE 'other' END AS cause FROM x""")
def gr24_disagreements(spark: SparkSession, d: str) -> DataFrame:
    modules = table(spark, d, "supplier").where("s_nationkey < 20").select(F.col("s_suppkey").alias("module"))
    causes = {"unknown module": ~F.col("known"), "conditional": (F.col("side") == "ours") & (F.col("src") % 2 == 0)}
    return g.disagreements(v.plain(spark, d, 1995), v.plain(spark, d, 1996), modules, causes)


@query(f"""WITH RECURSIVE {E}, {v.sql_edges('a', 1995)}, {v.sql_edges('b', 1996)},
ra AS (SELECT src AS x, dst AS y FROM a UNION SELECT r.x, a.dst FROM ra r JOIN a ON a.src = r.y),
rb AS (SELECT src AS x, dst AS y FROM b UNION SELECT r.x, b.dst FROM rb r JOIN b ON b.src = r.y)
SELECT module FROM (SELECT DISTINCT r.x AS module FROM rb r JOIN rb q ON r.x = q.y AND r.y = q.x)
WHERE module NOT IN (SELECT r.x FROM ra r JOIN ra q ON r.x = q.y AND r.y = q.x)""")
def so08_new_cycle_modules(spark: SparkSession, d: str) -> DataFrame:
    before, after = (g.cyclic(v.plain(spark, d, y)).select("module") for y in (1995, 1996))
    return after.join(before, "module", "left_anti")
