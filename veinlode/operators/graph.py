"""Graph operators over ``nodes`` and ``edges`` DataFrames; node ids may be of any type.

Edges are (src, dst); several graphs lie in one DataFrame when ``by`` names their key columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ratio
from ..sources.store import cut


def project(edges: DataFrame, owner: DataFrame, relations: Sequence[str] | None = None, loops: bool = False) -> DataFrame:
    """GR02, GR03: edges between nodes lifted to the modules that own them; ``owner`` is (node, module)."""
    kept = edges if relations is None else edges.where(F.col("relation").isin(list(relations)))
    lifted = (
        kept.join(owner.select(F.col("node").alias("src"), F.col("module").alias("_a")), "src")
        .join(owner.select(F.col("node").alias("dst"), F.col("module").alias("_b")), "dst")
        .select(F.col("_a").alias("src"), F.col("_b").alias("dst"))
    )
    return (lifted if loops else lifted.where("src <> dst")).distinct()


def coupling(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """GR04: (module, ca, ce, total) of every module; zero where it has no edge. One pass over the edges."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("module"), F.lit(1).alias("i")), F.struct(F.col("src").alias("module"), F.lit(0).alias("i")))).alias("e"))
    sums = ends.groupBy("e.module").agg(F.sum("e.i").alias("ca"), F.sum(1 - F.col("e.i")).alias("ce"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    both = modules.select("module").join(sums, "module", "left").select("module", zero("ca"), zero("ce"))
    return both.withColumn("total", F.col("ca") + F.col("ce"))


def density(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """GR07: one row of n, m, density, mean coupling, mean and largest out-degree (as a share of n - 1)."""
    out = edges.groupBy("src").count()
    m = out.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("m"), F.coalesce(F.max("count"), F.lit(0)).alias("most"))
    n = modules.agg(F.count("*").alias("n"))
    both = n.crossJoin(m)  # one row each
    many = F.col("n") > 1
    return both.select(
        "n",
        "m",
        F.when(many, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"),
        ratio(2 * F.col("m"), F.col("n")).alias("mean_coupling"),
        ratio(F.col("m"), F.col("n")).alias("mean_out"),
        F.when(many, F.col("most") / (F.col("n") - 1)).otherwise(0.0).alias("max_out"),
    )


def undirected(edges: DataFrame) -> DataFrame:
    """SX09: both directions of every edge, without loops."""
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def clustering(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """GR08: (module, degree, triangles, clustering).

    Each undirected edge points from its end of lower degree, so that a hub has few outgoing edges and the join
    that closes triangles stays near m * sqrt(m) at worst.
    """
    both = undirected(edges)
    degree = both.groupBy("src").agg(F.count("*").alias("k"))
    ranked = both.join(degree, "src").withColumnRenamed("k", "ks").join(degree.select(F.col("src").alias("dst"), F.col("k").alias("kd")), "dst")
    up = cut(ranked.where("ks < kd OR (ks = kd AND src < dst)").select("src", "dst"))
    wedge = up.select("src", F.col("dst").alias("u")).join(up.select("src", F.col("dst").alias("v")), "src").where("u < v")
    closed = up.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    corner = wedge.join(closed, ["u", "v"]).select(F.explode(F.array("src", "u", "v")).alias("module"))
    found = corner.groupBy("module").agg(F.count("*").alias("t"))
    all_ = modules.select("module").join(degree.withColumnRenamed("src", "module"), "module", "left").join(found, "module", "left")
    k, t = F.coalesce("k", F.lit(0)), F.coalesce("t", F.lit(0))
    return all_.select("module", k.alias("degree"), t.alias("triangles"), F.when(k > 1, 2 * t / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def degree_entropy(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """GR09: entropy of the shares of total degree, over log2 of the number of modules; 0 for one module or no edge."""
    d = coupling(modules, edges)
    s = d.agg(F.count("*").alias("n"), F.sum("total").alias("all"), F.sum(F.when(F.col("total") > 0, F.col("total") * F.log2("total"))).alias("x"))
    return s.select(F.when((F.col("n") > 1) & (F.col("all") > 0), (F.log2("all") - F.col("x") / F.col("all")) / F.log2("n")).otherwise(0.0).alias("entropy"))


def tarjan(nodes: Sequence, edges: Sequence[tuple]) -> list[list]:
    """Strongly connected components, without recursion."""
    out: dict = {v: [] for v in nodes}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    on: set = set()
    stack, found = [], []
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    part = []
                    while not part or part[-1] != v:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    found.append(part)
    return found


def cyclic_per_graph(edges: DataFrame, by: str) -> DataFrame:
    """GR05 for many graphs of moderate size: (by, module, component), of modules on a cycle or with a loop.

    One graph is one group, as a snapshot's modules are; graphs that don't fit a task go to ``cyclic``.
    """
    kind = edges.schema["src"].dataType

    def one(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        pairs = list(zip(g.src, g.dst))
        loops = {a for a, b in pairs if a == b}
        rows = [(key[0], v, min(c)) for c in tarjan([], pairs) if len(c) > 1 or c[0] in loops for v in c]
        return pd.DataFrame(rows, columns=[by, "module", "component"])

    out = T.StructType([T.StructField(by, edges.schema[by].dataType), T.StructField("module", kind), T.StructField("component", kind)])
    return edges.select(by, "src", "dst").groupBy(by).applyInPandas(one, out)


def trimmed(live: DataFrame) -> DataFrame:
    """The edges left after nodes without incoming or outgoing ones are cut off until there are none: each pass takes some,
    so it ends."""
    n = live.count()
    while n:
        live = cut(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        n, before = live.count(), n
        if n == before:
            break
    return live


def cyclic(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """GR05 for one graph of any size: (module, component) by trimming and forward-backward colouring.

    After trimming, every node takes the smallest node that reaches it as its colour; within a colour, what reaches
    that node is its component. Each round takes a component of every colour; reaching ``max_rounds`` raises.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("module"), F.col("src").alias("component")).distinct()
    live = cut(edges.where("src <> dst").select("src", "dst").distinct())
    done = None
    for _ in range(max_rounds):
        live = trimmed(live)
        if live.isEmpty():
            break
        colour = spread_least(live, live.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")), max_rounds)
        same = live.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("b")), "dst")
        same = cut(same.where("a = b").select("src", "dst", F.col("a").alias("colour")))
        back = cut(colour.where("node = colour"))
        while True:
            more = same.join(back.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour")
            grown = cut(back.union(more).distinct())
            if grown.count() == back.count():
                break
            back = grown
        done = back if done is None else cut(done.union(back))
        gone = back.select("node")
        live = cut(live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    else:
        if not live.isEmpty():
            raise RuntimeError(f"components are left after {max_rounds} rounds")
    found = loops if done is None else done.select(F.col("node").alias("module"), F.col("colour").alias("component"))
    if done is not None:
        size = found.groupBy("component").count().where("count > 1").select("component")
        found = found.join(size, "component", "left_semi").select("module", "component")
        found = found.union(loops.join(found, "module", "left_anti"))
    return found


def spread_least(edges: DataFrame, labels: DataFrame, max_rounds: int) -> DataFrame:
    """The smallest colour that reaches each node along the edges."""
    labels = cut(labels)
    for _ in range(max_rounds):
        sent = edges.join(labels.select(F.col("node").alias("src"), "colour"), "src").select(F.col("dst").alias("node"), "colour")
        new = cut(labels.union(sent).groupBy("node").agg(F.min("colour").alias("colour")))
        if new.join(labels.withColumnRenamed("colour", "old"), "node").where("colour <> old").isEmpty():
            return new
        labels = new
    raise RuntimeError(f"colours still change after {max_rounds} rounds")


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """GR14: (node, hop) within ``hops`` undirected steps of the seeds (node), with the fewest steps."""
    both = undirected(edges)
    seen = seeds.select("node").distinct().withColumn("hop", F.lit(0))
    for i in range(1, hops + 1):
        step = both.join(seen.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node"), F.lit(i).alias("hop"))
        seen = seen.union(step).groupBy("node").agg(F.min("hop").alias("hop"))
    return seen


def closure(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """GR19, GR20: (sha, ancestor) of all pairs along ``parents`` (sha, parent); distances double each round."""
    pairs = cut(parents.select("sha", F.col("parent").alias("ancestor")).distinct())
    n = pairs.count()
    for _ in range(max_rounds):
        far = pairs.join(pairs.select(F.col("sha").alias("ancestor"), F.col("ancestor").alias("far")), "ancestor").select("sha", F.col("far").alias("ancestor"))
        pairs = cut(pairs.union(far).distinct())
        n, before = pairs.count(), n
        if n == before:
            return pairs
    raise RuntimeError("the history is too deep, or has a cycle")


def chain_facts(parents: DataFrame, max_rounds: int = 64) -> DataFrame:
    """GR19, GR20: (sha, depth, least) along chains of one parent each: the number of ancestors, and the smallest of them.

    Each sha keeps one pointer, which doubles its reach in a round, so a history of n commits takes n rows and log n
    joins, not all pairs of an ancestor and a descendant.
    """
    far = parents.select("sha", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth"), F.col("parent").alias("least"))
    for _ in range(max_rounds):
        far = cut(far)
        step = far.select(F.col("sha").alias("at"), F.col("at").alias("_to"), F.col("depth").alias("_n"), F.col("least").alias("_m"))
        both = far.join(step, "at", "left")
        if both.where("_n IS NOT NULL").isEmpty():
            return far.select("sha", "depth", "least")
        far = both.select("sha", F.when(F.col("_n").isNull(), F.col("at")).otherwise(F.col("_to")).alias("at"), (F.col("depth") + F.coalesce("_n", F.lit(0))).alias("depth"), F.least("least", "_m").alias("least"))
    raise RuntimeError("the history is too deep, or has a cycle")


def owning_modules(nodes: DataFrame) -> DataFrame:
    """GR01: (id, module) of each node (id, parent_id, type, qualified_name): the nearest module at or above it, by its
    name; null where none is, as in a loop of parents. Pointers to the parent double their reach in a round, so that
    after as many rounds as the number of nodes has binary digits only loops are left."""
    up = nodes.select("id", F.when(F.col("type") == "module", F.col("qualified_name")).alias("module"), F.col("parent_id").alias("at"))
    for _ in range(nodes.count().bit_length()):
        up = cut(up)
        step = up.select(F.col("id").alias("at"), F.col("module").alias("_m"), F.col("at").alias("_to"), F.lit(True).alias("_is"))
        open_ = F.col("module").isNull() & F.coalesce("_is", F.lit(False))
        both = up.join(step, "at", "left")
        if both.where(open_).isEmpty():
            break
        up = both.select("id", F.coalesce("module", "_m").alias("module"), F.when(open_, F.col("_to")).otherwise(F.col("at")).alias("at"))
    return up.select("id", "module")


def touched_modules(modules: DataFrame, changed: DataFrame) -> DataFrame:
    """GR06: modules (module, path) whose file is among the changed paths (path), with slashes either way."""
    same = lambda c: F.replace(F.col(c), F.lit("\\"), F.lit("/"))
    return modules.withColumn("_p", same("path")).join(changed.select(same("path").alias("_p")).distinct(), "_p", "left_semi").select("module")


def touched_mask(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """GR18: nodes (id, path) with ``touched``: whether their file is among the changed paths (path)."""
    marked = changed.select("path").distinct().withColumn("_t", F.lit(True))
    return nodes.join(marked, "path", "left").withColumn("touched", F.coalesce("_t", F.lit(False))).drop("_t")


def constructor_edges(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR22: call edges (src, dst) in which a class that defines __init__ stands for that method; each once."""
    made = nodes.where("name = '__init__'").select(F.col("parent_id").alias("dst"), F.col("id").alias("_init"))
    return calls.join(made, "dst", "left").select("src", F.coalesce("_init", "dst").alias("dst")).distinct()


def internal_edges(edges: DataFrame, package: str) -> DataFrame:
    """GR23: edges between modules of the package, normalised: a package's __init__ is the package, no loops, each once."""
    plain = lambda c: F.regexp_replace(c, r"\.__init__$", "")
    inside = lambda c: (F.col(c) == package) | F.col(c).startswith(f"{package}.")
    e = edges.select(plain("src").alias("src"), plain("dst").alias("dst"))
    return e.where(inside("src") & inside("dst") & (F.col("src") != F.col("dst"))).distinct()


def disagreements(ours: DataFrame, theirs: DataFrame, modules: DataFrame, causes: dict[str, Column]) -> DataFrame:
    """GR24: (src, dst, side, cause) of the edges of one side only. A cause is the first whose test holds, of ``causes`` over
    ``src``, ``dst``, ``side`` and ``known`` (whether both ends are modules), else "other"."""
    one = ours.select("src", "dst").distinct().join(theirs, ["src", "dst"], "left_anti").withColumn("side", F.lit("ours"))
    two = theirs.select("src", "dst").distinct().join(ours, ["src", "dst"], "left_anti").withColumn("side", F.lit("theirs"))
    both = one.unionByName(two)
    for end in ("src", "dst"):
        both = both.join(modules.select(F.col("module").alias(end), F.lit(True).alias(f"_{end}")).distinct(), end, "left")
    both = both.withColumn("known", F.coalesce("_src", F.lit(False)) & F.coalesce("_dst", F.lit(False)))
    cause = F.lit("other")
    for name, test in reversed(causes.items()):
        cause = F.when(test, name).otherwise(cause)
    return both.select("src", "dst", "side", cause.alias("cause"))


def graph_change(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GR12, SO02 to SO04: added, removed and kept rows of two sets, and their Jaccard distance (0 if both are empty)."""
    a = before.select(*keys).distinct().withColumn("_a", F.lit(1))
    b = after.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = a.join(b, list(keys), "full_outer")
    s = both.agg(
        F.count_if(F.col("_a").isNull()).alias("added"),
        F.count_if(F.col("_b").isNull()).alias("removed"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("kept"),
    )
    return s.withColumn("distance", ratio(F.col("added") + F.col("removed"), F.col("added") + F.col("removed") + F.col("kept")))


def node_delta(before: DataFrame, after: DataFrame, old_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """GR13: (module, is_new, gained, lost) of each node of the later graph."""
    lost = before.join(after, ["src", "dst"], "left_anti").groupBy("src").agg(F.count("*").alias("lost"))
    gained = after.join(before, ["src", "dst"], "left_anti").groupBy("src").agg(F.count("*").alias("gained"))
    old = old_nodes.select("module", F.lit(True).alias("old")).distinct()
    out = nodes.select("module").join(old, "module", "left")
    for t in (gained, lost):
        out = out.join(t.withColumnRenamed("src", "module"), "module", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("module", F.col("old").isNull().alias("is_new"), zero("gained"), zero("lost"))
