"""From facts of files to one typed graph: names meet definitions by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.python_source import extract
from ..sources.store import cut, write_tables


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose sides are never broadcast: the planner takes files and facts for as small as the table that they are made from."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def packages(files: DataFrame) -> DataFrame:
    """AX02: (snapshot_id, folder) of the folders with an __init__.py."""
    return files.where(F.col("path").endswith("/__init__.py")).select("snapshot_id", F.regexp_replace("path", "/__init__.py$", "").alias("folder")).distinct()


def with_modules(files: DataFrame) -> DataFrame:
    """AX03: files with ``module``, the dotted name below the highest package of an unbroken run above the file."""
    parts = F.split(F.regexp_replace("path", r"\.py$", ""), "/")
    depth = files.withColumn("_p", parts).withColumn("_d", F.explode(F.sequence(F.lit(0), F.size("_p") - 1)))
    folder = F.when(F.col("_d") > 0, F.concat_ws("/", F.slice("_p", 1, F.col("_d"))))
    known = packages(files).withColumnRenamed("folder", "_f").withColumn("_is", F.lit(True))
    seen = joined(depth.withColumn("_f", folder), known, ["snapshot_id", "_f"], "left")
    # The deepest folder that is no package: names start below it.
    top = seen.where("_is IS NULL").groupBy("snapshot_id", "path").agg(F.max("_d").alias("_top"))
    named = joined(files.withColumn("_p", parts), top, ["snapshot_id", "path"])
    name = F.slice("_p", F.col("_top") + 1, F.size("_p") - F.col("_top"))
    name = F.when((F.element_at(name, -1) == "__init__") & (F.size(name) > 1), F.slice(name, 1, F.size(name) - 1)).otherwise(name)
    return named.select(*files.columns, F.concat_ws(".", name).alias("module"))


def nodes(facts: DataFrame) -> DataFrame:
    """AX12: one node per id: classes before functions and methods, others, variables; of equals the last line."""
    s = facts.where("kind = 'symbol'")
    order = F.when(F.col("type") == "class", 0).when(F.col("type").isin("function", "method"), 1).when(F.col("type") == "global_variable", 3).otherwise(2)
    best = F.row_number().over(Window.partitionBy("snapshot_id", "id").orderBy(order, F.desc("line")))
    return s.withColumn("_r", best).where("_r = 1").select("snapshot_id", "id", "name", "qualified_name", "parent_id", "type", "path", "line", "end_line", "complexity")


def unique_names(found: DataFrame, name: str) -> DataFrame:
    """AX13: names that exactly one node has: (snapshot_id, name, id, type)."""
    return found.groupBy("snapshot_id", name).agg(F.count("*").alias("_n"), F.first("id").alias("_id"), F.first("type").alias("_type")).where("_n = 1").drop("_n")


def resolve(uses: DataFrame, found: DataFrame, facts: DataFrame, rounds: int = 5) -> DataFrame:
    """AX16, AX17: ``uses`` (snapshot_id, id, target, ...) with ``to`` and ``to_type``; names follow re-exports.

    In each round a name that no node has is looked up as an alias, by its longest prefix that is one; the rounds end
    when none is.
    """
    names = unique_names(found, "qualified_name").withColumnRenamed("qualified_name", "target")
    alias = facts.where("kind = 'alias'").select("snapshot_id", F.col("qualified_name").alias("_from"), F.col("target").alias("_onto")).distinct()
    alias = alias.groupBy("snapshot_id", "_from").agg(F.min("_onto").alias("_onto"))
    keys = uses.select("snapshot_id", "target").where("target IS NOT NULL").distinct().withColumn("_at", F.col("target"))
    for _ in range(rounds):
        known = joined(keys, names.select("snapshot_id", F.col("target").alias("_at"), F.lit(True).alias("_is")), ["snapshot_id", "_at"], "left")
        parts = known.where("_is IS NULL").withColumn("_p", F.split("_at", r"\.")).withColumn("_k", F.explode(F.sequence(F.lit(1), F.size("_p"))))
        parts = parts.withColumn("_from", F.concat_ws(".", F.slice("_p", 1, F.col("_k"))))
        hit = cut(joined(parts, alias, ["snapshot_id", "_from"]).where(F.col("_onto") != F.col("_from")))
        if hit.isEmpty():
            break
        rest = F.concat_ws(".", F.slice("_p", F.col("_k") + 1, F.size("_p")))
        new = F.when(rest == "", F.col("_onto")).otherwise(F.concat_ws(".", "_onto", rest))
        moved = hit.groupBy("snapshot_id", "target").agg(F.max_by(new, "_k").alias("_new"))
        keys = joined(keys, moved, ["snapshot_id", "target"], "left").select("snapshot_id", "target", F.coalesce("_new", "_at").alias("_at"))
    final = joined(keys, names.withColumnRenamed("target", "_at"), ["snapshot_id", "_at"]).select("snapshot_id", "target", F.col("_id").alias("to"), F.col("_type").alias("to_type"))
    final = cut(final)  # both sides are dealt anew, so that the uses of a frequent name can be split over tasks
    return joined(uses, final, ["snapshot_id", "target"], "left")


def edges(facts: DataFrame, found: DataFrame) -> DataFrame:
    """AX14 to AX20: (snapshot_id, source, target, type), each once.

    CONTAINS from parents; IMPORTS to the target module, else the module it is taken from, else an external
    name; CALLS by full name, else, where no import leads to it, by a short name that is unique; INHERITS by full name;
    calls and bases that turn out to be variables are ACCESSES_GLOBAL, as are uses of module variables.
    """
    row = lambda df, kind: df.select("snapshot_id", F.col("id").alias("source"), F.col("to").alias("target"), kind.alias("type"))
    contains = found.where("parent_id IS NOT NULL").select("snapshot_id", F.col("parent_id").alias("source"), F.col("id").alias("target"), F.lit("CONTAINS").alias("type"))
    modules = found.where("type = 'module'").select("snapshot_id", F.col("qualified_name").alias("_m"), F.col("id").alias("_mid"))
    imports = facts.where("kind = 'import'").select("snapshot_id", "id", "target", "from_module")
    imports = joined(imports, modules.select("snapshot_id", F.col("_m").alias("target"), F.col("_mid").alias("_a")), ["snapshot_id", "target"], "left")
    imports = joined(imports, modules.select("snapshot_id", F.col("_m").alias("from_module"), F.col("_mid").alias("_b")), ["snapshot_id", "from_module"], "left")
    outside = F.concat(F.lit("external:"), F.coalesce("from_module", "target"))
    imports = imports.withColumn("to", F.coalesce("_a", "_b", outside))
    retype = lambda kind: F.when(F.col("to_type") == "global_variable", "ACCESSES_GLOBAL").otherwise(kind)
    uses = facts.where("kind IN ('call', 'inherit', 'global')").select("snapshot_id", "id", "kind", "name", "target", "via_import")
    uses = cut(resolve(uses, found, facts))
    calls = uses.where("kind = 'call'")
    short = unique_names(found.where("type IN ('function', 'method', 'class')"), "name").select("snapshot_id", "name", F.col("_id").alias("_sid"), F.col("_type").alias("_stype"))
    calls = joined(calls, short, ["snapshot_id", "name"], "left")
    loose = F.col("to").isNull() & ~F.coalesce("via_import", F.lit(False))
    calls = calls.withColumn("to_type", F.when(loose, F.col("_stype")).otherwise(F.col("to_type"))).withColumn("to", F.when(loose, F.col("_sid")).otherwise(F.col("to")))
    bases, uses = uses.where("kind = 'inherit'"), uses.where("kind = 'global' AND to_type = 'global_variable'")
    parts = [contains, row(imports, F.lit("IMPORTS")), row(calls, retype("CALLS")), row(bases, retype("INHERITS")), row(uses, F.lit("ACCESSES_GLOBAL"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("target IS NOT NULL").distinct()


KINDS = ["CONTAINS", "IMPORTS", "CALLS", "INHERITS", "ACCESSES_GLOBAL"]


def node_features(found: DataFrame, links: DataFrame) -> DataFrame:
    """AX21: nodes with in- and out-degree and out-degree by relation, 0 where there is none."""
    out = links.groupBy("snapshot_id", F.col("source").alias("id")).agg(F.count("*").alias("out_degree"), *[F.count_if(F.col("type") == k).alias(k.lower()) for k in KINDS])
    into = links.groupBy("snapshot_id", F.col("target").alias("id")).agg(F.count("*").alias("in_degree"))
    both = joined(joined(found, out, ["snapshot_id", "id"], "left"), into, ["snapshot_id", "id"], "left")
    return both.fillna(0, ["out_degree", "in_degree", *[k.lower() for k in KINDS]])


def syntax_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """AX23: names of imports and definitions per path that one side has and the other lacks."""
    names = lambda df: df.where("kind IN ('import', 'symbol')").groupBy("path").agg(F.collect_set(F.coalesce("target", "qualified_name")).alias("n"))
    both = names(before).withColumnRenamed("n", "a").join(names(after).withColumnRenamed("n", "b"), "path", "full_outer")
    empty = F.array().cast("array<string>")
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    return both.select("path", F.array_sort(F.array_except(b, a)).alias("added"), F.array_sort(F.array_except(a, b)).alias("removed"))


def write_analysis(files: DataFrame, root: str) -> dict[str, DataFrame]:
    """SX01: facts, graph and node features of files (snapshot_id, path, source, module), written as the tables nodes, edges and
    features below ``root``, a shared folder, and read from there."""
    facts = cut(extract(files))
    found = cut(nodes(facts))
    links = cut(edges(facts, found))
    return write_tables(root, nodes=found, edges=links, features=node_features(found, links))
