"""Queries of the source facts and of name resolution, row by row, on generated package trees with a module per part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels as lb
from ..operators import resolution as rs
from ..sources import python_source as ps
from ..sources.store import cut, table
from .model_queries import graph, sources
from .registry import query

#: Path, module and the module before it, of each part, as in ``model_queries.sources``.
PART = """p AS (SELECT p_partkey AS k, 'src/pkg' || (p_partkey % 5) || '/m' || p_partkey || '.py' AS path, 'pkg' || (p_partkey % 5) || '.m' || p_partkey AS m, greatest(1, p_partkey - 1) AS b FROM part),
f AS (SELECT k, b, path || ':' || m AS id, m, 'src/pkg' || (b % 5) || '/m' || b || '.py:pkg' || (b % 5) || '.m' || b AS bid, 'pkg' || (b % 5) || '.m' || b AS bm FROM p)"""


def facts(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return ps.extract(rs.with_modules(sources(spark, d))).where(F.col("kind") == kind)


def edges(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return graph(spark, d)[1].where(F.col("type") == kind).select("source", "target")


def tree(spark: SparkSession, d: str, files: dict[str, str]) -> DataFrame:
    """Files of a package p<part key> for each part; ``{k}`` in a text is the key."""
    k = F.col("p_partkey").cast("string")
    fill = lambda s: F.replace(F.lit(s), F.lit("{k}"), k)
    each = F.explode(F.array(*[F.struct(fill("src/p{k}/" + n).alias("path"), fill(s).alias("source")) for n, s in files.items()])).alias("f")
    return rs.with_modules(table(spark, d, "part").select(each).select("f.*").withColumn("snapshot_id", F.lit("s")))


def tree_edges(files: DataFrame, kind: str) -> DataFrame:
    found = cut(ps.extract(files))
    return rs.edges(found, cut(rs.nodes(found))).where(F.col("type") == kind).select("source", "target")


@query("SELECT 'src/pkg' || i AS folder FROM range(0, 5) t(i)")
def ax02_packages(spark: SparkSession, d: str) -> DataFrame:
    return rs.packages(sources(spark, d)).select("folder")


@query("""SELECT 'p' || p_partkey || '.' || t.x AS target, 'p' || p_partkey || t.o AS from_module FROM part, (VALUES ('a', ''), ('c.d', '.c')) t(x, o)""")
def ax04_relative_imports(spark: SparkSession, d: str) -> DataFrame:
    files = tree(spark, d, {"__init__.py": "", "m.py": "from . import a\nfrom .c import d\nfrom .. import gone\n"})
    return ps.extract(files).where("kind = 'import'").select("target", "from_module")


@query(f"""WITH {PART} SELECT id || s AS id, id || o AS parent_id, t AS type FROM f, (VALUES ('', NULL, 'module'), ('.X' || 0, '', 'global_variable')) x(s, o, t) WHERE t = 'module'
UNION ALL SELECT id || '.X' || k, id, 'global_variable' FROM f UNION ALL SELECT id || '.C' || k, id, 'class' FROM f UNION ALL SELECT id || '.C' || k || '.run', id || '.C' || k, 'method' FROM f UNION ALL SELECT id || '.f' || k, id, 'function' FROM f""")
def ax05_symbols(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "symbol").where("path NOT LIKE '%__init__.py'").select("id", "parent_id", "type")


@query(f"""WITH {PART} SELECT id || '.C' || k AS id, 4 AS line, 7 AS end_line, NULL::INTEGER AS complexity FROM f UNION ALL SELECT id || '.C' || k || '.run', 5, 7, 3 FROM f UNION ALL SELECT id || '.f' || k, 8, 9, 1 FROM f""")
def ax06_symbol_attributes(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "symbol").where("type IN ('class', 'method', 'function')").select("id", "line", "end_line", "complexity")


@query(f"WITH {PART} SELECT id || '.C' || k || '.run' AS id, 'X' || k AS name, m || '.X' || k AS target FROM f UNION ALL SELECT id || '.C' || k || '.run', 'f' || b, bm || '.f' || b FROM f")
def ax07_global_accesses(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "global").select("id", "name", "target")


@query(f"WITH {PART} SELECT id, 'os' AS target, NULL AS from_module FROM f UNION ALL SELECT id, bm || '.f' || b, bm FROM f")
def ax08_imports(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "import").select("id", "target", "from_module")


@query(f"WITH {PART} SELECT id || '.C' || k || '.run' AS id, bm || '.f' || b AS target, true AS via_import FROM f UNION ALL SELECT id || '.f' || k, m || '.C' || k, false FROM f")
def ax09_qualified_calls(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d, "call").select("id", "target", "via_import")


@query("SELECT 'p' || p_partkey || '.m.' || n AS name, l AS line FROM part, (VALUES ('A', 1), ('B', 2), ('C', 2), ('D', 4), ('E', 6), ('i', 7), ('G', 8)) t(n, l)")
def ax10_module_variables(spark: SparkSession, d: str) -> DataFrame:
    code = "A = 1\nB, C = 1, 2\nif A:\n    D = 1\ntry:\n    E: int = 2\n    for i in B:\n        G = 0\nexcept ValueError:\n    pass\ndef f():\n    local = 1\nA = 3\n"
    files = tree(spark, d, {"__init__.py": "", "m.py": code})
    return ps.extract(files).where("type = 'global_variable'").select(F.col("qualified_name").alias("name"), "line")


@query("SELECT type, n * (SELECT count(*) FROM part) + x AS n FROM (VALUES ('module', 1, 5), ('global_variable', 1, 0), ('class', 1, 0), ('method', 1, 0), ('function', 1, 0)) t(type, n, x)")
def ax12_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d)[0].groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT 'C' || p_partkey AS name, 'class' AS type FROM part UNION ALL SELECT 'f' || p_partkey, 'function' FROM part")
def ax13_unique_names(spark: SparkSession, d: str) -> DataFrame:
    found = graph(spark, d)[0].where("type IN ('class', 'function', 'method')")
    return rs.unique_names(found, "name").select("name", F.col("_type").alias("type"))


@query(f"WITH {PART} SELECT id AS source, bid AS target FROM f")
def ax14_resolved_modules(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, "IMPORTS").where("target NOT LIKE 'external:%'")


@query(f"WITH {PART} SELECT id AS source, 'external:os' AS target FROM f")
def ax15_external_modules(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, "IMPORTS").where("target LIKE 'external:%'")


@query(f"WITH {PART} SELECT id || '.C' || k || '.run' AS source, bid || '.f' || b AS target FROM f UNION ALL SELECT id || '.f' || k, id || '.C' || k FROM f")
def ax16_resolved_calls(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, "CALLS")


@query("SELECT 'src/p' || p_partkey || '/b.py:p' || p_partkey || '.b.g' AS source, 'src/p' || p_partkey || '/a.py:p' || p_partkey || '.a.f' AS target FROM part")
def ax17_reexported_calls(spark: SparkSession, d: str) -> DataFrame:
    return tree_edges(tree(spark, d, {"__init__.py": "from p{k}.a import f\n", "a.py": "def f():\n    pass\n", "b.py": "from p{k} import f\ndef g():\n    return f()\n"}), "CALLS")


@query("SELECT 'src/p' || p_partkey || '/a.py:p' || p_partkey || '.a.D' AS source, 'src/p' || p_partkey || '/a.py:p' || p_partkey || '.a.X' AS target FROM part")
def ax18_retyped_uses(spark: SparkSession, d: str) -> DataFrame:
    return tree_edges(tree(spark, d, {"__init__.py": "", "a.py": "X = object\nclass D(X):\n    pass\n"}), "ACCESSES_GLOBAL")


@query(f"WITH {PART} SELECT id || '.C' || k || '.run' AS source, id || '.X' || k AS target FROM f")
def ax20_global_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d, "ACCESSES_GLOBAL")


def edited(spark: SparkSession, d: str) -> DataFrame:
    """(k, before, after): docstrings, imports or code change, or a side is broken or gone."""
    k = F.col("p_partkey")
    code = F.concat(F.lit('"""Old."""\nimport os\ndef f'), k.cast("string"), F.lit("(x):\n    return x + 1\n"))
    s = k % 6
    after = F.when(s == 0, F.replace(code, F.lit("Old"), F.lit("New"))).when(s == 1, F.replace(code, F.lit("import os"), F.lit("import sys"))).when(s == 2, F.replace(code, F.lit("x + 1"), F.lit("x + 2"))).when(s == 3, F.lit("def (\n")).when(s == 4, code)
    return table(spark, d, "part").select(k.alias("k"), code.alias("before"), after.alias("after"))


@query("SELECT p_partkey AS k, CASE p_partkey % 6 WHEN 3 THEN 'parse_error' WHEN 5 THEN 'missing' ELSE 'ok' END AS status, CASE p_partkey % 6 WHEN 1 THEN 'sys' WHEN 3 THEN '' WHEN 5 THEN '' ELSE 'os' END AS imports, CASE WHEN p_partkey % 6 IN (3, 5) THEN '' ELSE 'f' || p_partkey END AS declared FROM part")
def ax22_review_facts(spark: SparkSession, d: str) -> DataFrame:
    out = ps.review_facts(edited(spark, d).select("k", F.col("after").alias("source")), ["k"])
    return out.select("k", "status", F.concat_ws(",", "imports").alias("imports"), F.concat_ws(",", "declared").alias("declared"))


@query("SELECT 'm' || p_partkey || '.py' AS path, CASE p_partkey % 6 WHEN 1 THEN 'sys' ELSE '' END AS added, CASE p_partkey % 6 WHEN 1 THEN 'os' ELSE '' END AS removed FROM part WHERE p_partkey % 6 IN (0, 1, 2, 4)")
def ax23_syntax_delta(spark: SparkSession, d: str) -> DataFrame:
    e = edited(spark, d).where("k % 6 IN (0, 1, 2, 4)")
    name = F.concat(F.lit("m"), F.col("k").cast("string"))
    side = lambda c: ps.extract(e.select(F.lit("s").alias("snapshot_id"), F.concat(name, F.lit(".py")).alias("path"), name.alias("module"), F.col(c).alias("source")))
    out = rs.syntax_delta(side("before"), side("after"))
    return out.select("path", F.concat_ws(",", "added").alias("added"), F.concat_ws(",", "removed").alias("removed"))


@query("SELECT p_partkey AS k, p_partkey % 6 IN (0, 4) AS same FROM part")
def ax24_executable_equality(spark: SparkSession, d: str) -> DataFrame:
    return hashes(spark, d).select("k", F.coalesce(F.col("before_hash") == F.col("after_hash"), F.lit(False)).alias("same"))


def hashes(spark: SparkSession, d: str) -> DataFrame:
    e = edited(spark, d)
    side = lambda c, n: ps.review_facts(e.select("k", F.col(c).alias("source")), ["k"]).select("k", F.col("executable").alias(n))
    return side("before", "before_hash").join(side("after", "after_hash"), "k")


@query("SELECT (p_partkey % 6) * 1000 + p_partkey // 12 AS sample_id FROM part GROUP BY 1 HAVING bool_and(p_partkey % 6 IN (0, 4) AND p_partkey % 7 > 0)")
def lb09_without_executable_change(spark: SparkSession, d: str) -> DataFrame:
    k, path = F.col("k"), F.concat(F.lit("m"), F.col("k").cast("string"))
    rows = hashes(spark, d).select(((k % 6) * 1000 + F.floor(k / 12)).alias("sample_id"), F.when(k % 7 > 0, "M").otherwise("R").alias("status"), path.alias("before_path"), path.alias("after_path"), "before_hash", "after_hash")
    return lb.without_executable_change(rows)
