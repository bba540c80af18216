"""Queries of source facts, models and explanations."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import explain as ex
from ..operators import models as ml
from ..operators import resolution as rs
from ..sources import python_source as ps
from ..sources.store import cut, table
from . import views as v
from .registry import query


def sources(spark: SparkSession, d: str) -> DataFrame:
    """A package tree with a module per part that imports from the module before it."""
    k = F.col("p_partkey")
    b = F.greatest(F.lit(1), k - 1)
    code = F.format_string(
        "import os\nfrom pkg%d.m%d import f%d\nX%d = 1\nclass C%d(Base):\n    def run(self):\n        if X%d and self:\n            return f%d()\ndef f%d():\n    return C%d()\n",
        b % 5, b, b, k, k, k, b, k, k,
    )
    files = table(spark, d, "part").select(F.format_string("src/pkg%d/m%d.py", k % 5, k).alias("path"), code.alias("source"))
    inits = spark.range(5).select(F.format_string("src/pkg%d/__init__.py", F.col("id")).alias("path"), F.lit("").alias("source"))
    return files.union(inits).withColumn("snapshot_id", F.lit("s"))


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    facts = cut(ps.extract(rs.with_modules(sources(spark, d))))
    found = cut(rs.nodes(facts))
    return found, rs.edges(facts, found)


@query("""SELECT 'src/pkg' || (p_partkey % 5) || '/m' || p_partkey || '.py' AS path, 'pkg' || (p_partkey % 5) || '.m' || p_partkey AS module FROM part
UNION ALL SELECT 'src/pkg' || i || '/__init__.py', 'pkg' || i FROM range(0, 5) t(i)""")
def ax03_module_names(spark: SparkSession, d: str) -> DataFrame:
    return rs.with_modules(sources(spark, d)).select("path", "module")


@query("""SELECT kind, n * (SELECT count(*) FROM part) + x AS n FROM (VALUES ('symbol', 5, 5), ('import', 2, 0), ('alias', 1, 0), ('call', 2, 0), ('inherit', 1, 0), ('global', 2, 0)) t(kind, n, x)""")
def ax01_source_facts(spark: SparkSession, d: str) -> DataFrame:
    return ps.extract(rs.with_modules(sources(spark, d))).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT type, n * (SELECT count(*) FROM part) AS n FROM (VALUES ('CONTAINS', 4), ('IMPORTS', 2), ('CALLS', 2), ('ACCESSES_GLOBAL', 1)) t(type, n)""")
def ax19_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d)[1].groupBy("type").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT p_partkey AS k, greatest(1, p_partkey - 1) AS b FROM part), c AS (SELECT b, count(*) AS n FROM p GROUP BY 1)
SELECT 'src/pkg' || (k % 5) || '/m' || k || '.py:pkg' || (k % 5) || '.m' || k || '.f' || k AS id, 1 AS out_degree, 1 + coalesce(n, 0) AS in_degree, 1 AS calls FROM p LEFT JOIN c ON c.b = k""")
def ax21_node_features(spark: SparkSession, d: str) -> DataFrame:
    found, links = graph(spark, d)
    return rs.node_features(found, links).where("type = 'function'").select("id", F.col("out_degree").cast("int").alias("out_degree"), "in_degree", F.col("calls").cast("int").alias("calls"))


@query("""SELECT 'method' AS type, count(*) AS n, 3 AS complexity FROM part UNION ALL SELECT 'function', count(*), 1 FROM part""")
def ax11_complexity(spark: SparkSession, d: str) -> DataFrame:
    s = ps.extract(rs.with_modules(sources(spark, d))).where("kind = 'symbol' AND type IN ('method', 'function')")
    return s.groupBy("type", "complexity").agg(F.count("*").alias("n")).select("type", "n", "complexity")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))


@query()
def ml01_logistic(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("features", array_to_vector("x"))
    return ml.probability(ml.logistic(rows), rows).select("vec_id", "label", "score")


@query()
def ml03_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("features", array_to_vector("x"))
    return ml.projection(rows, "features", 8)(rows, "parts").select("vec_id", "parts")


@query()
def ml05_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select("vec_id", "label", array_to_vector(F.slice("x", 1, 32)).alias("a"), array_to_vector(F.slice("x", 33, 32)).alias("b"))
    return ml.fusion(rows, "a", "b", 8)(rows).select("vec_id", "label", "score")


@query()
def ml07_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("features", array_to_vector("x"))
    return ml.probability(ml.boosted(rows), rows).select("vec_id", "label", "score")


@query()
def ml07_forest(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).withColumn("features", array_to_vector("x"))
    return ml.probability(ml.forest(rows), rows).select("vec_id", "label", "score")


@query("SELECT p_partkey, round(1 / (1 + exp(-(p_size - 25) / 10.0::DOUBLE)), 9) AS score, (p_size - 25) / 10.0::DOUBLE >= 0.5 AS flagged FROM part")
def ml08_rule_gate(spark: SparkSession, d: str) -> DataFrame:
    delta = (F.col("p_size") - 25) / 10.0
    return table(spark, d, "part").select("p_partkey", F.round(ml.rule_gate(delta), 9).alias("score"), (delta >= 0.5).alias("flagged"))


@query(f"""WITH {v.EDGES}, {v.sql_edges('e', 1995)}, x AS (SELECT s_suppkey AS id, (s_suppkey % 7)::DOUBLE AS a, (s_suppkey % 11)::DOUBLE AS b FROM supplier),
m AS (SELECT dst AS id, avg(a) AS a, avg(b) AS b FROM e JOIN x ON x.id = e.src GROUP BY dst)
SELECT x.id, round(x.a + greatest(0, 0.5 * x.a - 0.25 * x.b + coalesce(m.a, 0)), 6) AS h0, round(x.b + greatest(0, 0.1 * x.a + 0.2 * x.b - 0.5 * coalesce(m.a, 0) + 0.5 * coalesce(m.b, 0)), 6) AS h1 FROM x LEFT JOIN m ON m.id = x.id""")
def ml09_message_pass(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    nodes = table(spark, d, "supplier").select(k.alias("id"), F.array((k % 7).cast("double"), (k % 11).cast("double")).alias("x"))
    out = ml.message_pass(nodes, v.plain(spark, d, 1995), [[0.5, -0.25], [0.1, 0.2]], [[1.0, 0.0], [-0.5, 0.5]])
    return out.select("id", F.round(F.col("x")[0], 6).alias("h0"), F.round(F.col("x")[1], 6).alias("h1"))


@query("""SELECT l_orderkey, l_linenumber, round((l_tax - 0.01 + l_discount * l_tax - l_discount) / 2, 9) AS structure, round((l_discount - 0.01 + l_discount * l_tax - l_tax) / 2, 9) AS history FROM lineitem""")
def xr05_two_player_shapley(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("l_tax"), F.col("l_discount")
    s = ex.two_player(F.lit(0.01), a, b, a * b)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(s[c], 9).alias(c) for c in ("structure", "history")])


@query("""SELECT vec_id, round(0.1 + list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE * 0.5)) + list_sum(list_transform(embedding[33:64], lambda x: x::DOUBLE * -0.25)), 5) AS logit,
round(list_sum(list_transform(embedding[1:32], lambda x: x::DOUBLE * 0.5)), 5) AS structure FROM embeddings""")
def xr07_branch_contributions(spark: SparkSession, d: str) -> DataFrame:
    w = lambda x: F.array_repeat(F.lit(x), 32)
    b = ex.branches(F.lit(0.1), (F.slice("embedding", 1, 32), w(0.5)), (F.slice("embedding", 33, 32), w(-0.25)))
    return table(spark, d, "embeddings").select("vec_id", F.round(b["logit"], 5).alias("logit"), F.round(b["structure"], 5).alias("structure"))


@query("""WITH r AS (SELECT l_orderkey AS sample, (l_tax - 0.04) * 10 AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs((l_tax - 0.04) * 10) DESC, l_linenumber * 100000 + l_partkey) AS r FROM lineitem),
s AS (SELECT sample, sum(a) AS x, sum(CASE WHEN r <= 2 THEN a ELSE 0 END) AS y FROM r GROUP BY 1), p AS (SELECT sample, 1 / (1 + exp(-x)) AS p, 1 / (1 + exp(-y)) AS q FROM s)
SELECT sample, round(1 - exp(-(p * ln(p / q) + (1 - p) * ln((1 - p) / (1 - q)))), 6) AS unfaithfulness FROM p""")
def xr04_unfaithfulness(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), ((F.col("l_tax") - 0.04) * 10).alias("a"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("t"))
    return ex.unfaithfulness(parts, "sample", "a", "t", 2).withColumn("unfaithfulness", F.round("unfaithfulness", 6))


@query("""SELECT l_orderkey AS sample, CASE WHEN l_returnflag = 'N' THEN '(external)' ELSE l_returnflag END AS file, round(sum(l_tax), 6) AS attribution, bool_or(l_quantity > 40) AS touched FROM lineitem GROUP BY 1, 2""")
def ag13_attribution_by_file(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("f"), "l_tax", (F.col("l_quantity") > 40).alias("t"))
    return ex.by_file(parts, "sample", "f", "l_tax", "t").withColumn("attribution", F.round("attribution", 6))


PAIRS = "p AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS a, max(CASE WHEN turn = 1 THEN text END) AS b FROM conversations GROUP BY 1)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b"))


@query(f"""WITH {PAIRS}, x AS (SELECT conv_id, unnest(regexp_extract_all(lower(a), '[a-z0-9]+')) AS g FROM p), y AS (SELECT conv_id, unnest(regexp_extract_all(lower(b), '[a-z0-9]+')) AS g FROM p),
xc AS (SELECT conv_id, g, count(*) AS n FROM x GROUP BY ALL), yc AS (SELECT conv_id, g, count(*) AS n FROM y GROUP BY ALL),
m AS (SELECT conv_id, sum(least(xc.n, yc.n)) AS m FROM xc JOIN yc USING (conv_id, g) GROUP BY 1), s AS (SELECT conv_id, sum(n) AS n FROM xc GROUP BY 1), t AS (SELECT conv_id, sum(n) AS n FROM yc GROUP BY 1),
k AS (SELECT conv_id FROM s UNION SELECT conv_id FROM t)
SELECT conv_id, round(coalesce(2.0::DOUBLE * m / (s.n + t.n), 0), 6) AS f1 FROM k LEFT JOIN m USING (conv_id) LEFT JOIN s USING (conv_id) LEFT JOIN t USING (conv_id)""")
def ev20_rouge_1(spark: SparkSession, d: str) -> DataFrame:
    return ex.rouge_n(pairs(spark, d), "conv_id", "a", "b", 1).select("conv_id", F.round("f1", 6).alias("f1"))


@query()
def ev20_rouge_l(spark: SparkSession, d: str) -> DataFrame:
    return ex.rouge_l(pairs(spark, d).where("a IS NOT NULL AND b IS NOT NULL"), "conv_id", "a", "b")


@query(f"""WITH {v.PREDICTIONS} SELECT sample_id, sample_id || ' is ' || CASE WHEN score >= 0.5 THEN 'likely to degrade' ELSE 'not likely to degrade' END || ' (' || format('{{:.3f}}', score) || '). Evidence: ' || split AS answer FROM p""")
def xr20_template_answers(spark: SparkSession, d: str) -> DataFrame:
    p = v.predictions(spark, d)
    answer = ex.template_answer(F.col("sample_id").cast("string"), F.col("score"), F.lit(0.5), F.array("split"))
    return p.select("sample_id", answer.alias("answer"))
