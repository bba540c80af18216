"""XR11: evidence tags of a scored change set, as a union of rule queries, weighted to add up to 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import instability
from .retrieval import normalised_weights

# A hub has so many incoming couplings, or lies at this share of its change set's modules; a god node has so many edges.
HUB, HUB_SHARE, GOD = 10, 0.9, 15


def raised(attribution: str = "attribution") -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(F.col(attribution), F.lit(0.0)))


def signature(samples: DataFrame, touched: DataFrame, modules: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(sample, tag, weight).

    ``samples``: sample, risk_score, threshold, creates_cycle. ``touched``: sample, module. ``modules``: sample, module,
    ca_before, ce_before, ca_after, ce_after, in_cycle. ``edges``: sample, source, source_module, relation, target,
    target_module, attribution, added. ``nodes``: sample, id, type, module, attribution. Facts without an attribution
    of their own weigh the mean positive one of their sample, or 1.
    """
    e = edges.withColumn("w", raised()).where("w > 0")
    n = nodes.withColumn("w", raised()).where("w > 0")
    mean = e.select("sample", "w").union(n.select("sample", "w")).groupBy("sample").agg(F.avg("w").alias("mean"))
    base = samples.join(mean, "sample", "left").withColumn("mean", F.coalesce("mean", F.lit(1.0)))

    whole = base.select("sample", F.col("mean").alias("weight"), F.explode(F.array_compact(F.array(
        F.when(F.col("creates_cycle"), "new_cycle"),
        F.when(F.coalesce("risk_score", F.lit(0.0)) < F.coalesce("threshold", F.lit(0.0)), "low_risk"),
    ))).alias("tag"))

    per = Window.partitionBy("sample")
    placed = modules.withColumn("_r", F.row_number().over(per.orderBy("ca_after", "module"))).withColumn("_n", F.count("*").over(per))
    cutoff = placed.groupBy("sample").agg(F.max(F.when(F.col("_r") == F.ceil(F.col("_n") * HUB_SHARE), F.col("ca_after"))).alias("cutoff"))
    m = modules.join(touched.select("sample", "module").distinct(), ["sample", "module"], "left_semi").join(cutoff, "sample").join(base.select("sample", "mean"), "sample")
    hub = (F.col("ca_after") >= HUB) | ((F.col("ca_after") > 0) & (F.col("ca_after") >= F.col("cutoff")))
    unstable = instability(F.col("ca_after"), F.col("ce_after")) > instability(F.col("ca_before"), F.col("ce_before")) + 1e-12
    facts = m.select("sample", F.col("mean").alias("weight"), F.explode(F.array_compact(F.array(
        F.when(F.col("in_cycle"), "import_cycle_member"),
        F.when(F.col("ce_after") > F.col("ce_before"), "efferent_growth"),
        F.when(hub, "afferent_hub"),
        F.when(unstable, "instability_rise"),
    ))).alias("tag"))

    apart = F.col("source_module") != F.col("target_module")
    links = e.select("sample", F.col("w").alias("weight"), F.explode(F.array_compact(F.array(
        F.when((F.col("relation") == "CALLS") & apart, "cross_module_call"),
        F.when(F.col("added"), "added_dependency"),
        F.when(F.col("relation") == "ACCESSES_GLOBAL", "global_state"),
        F.when((F.col("relation") == "INHERITS") & apart, "inheritance_coupling"),
    ))).alias("tag"))
    imports = e.where(F.col("relation") == "IMPORTS").where(apart)
    back = imports.select("sample", F.col("target_module").alias("source_module"), F.col("source_module").alias("target_module")).distinct()
    mutual = imports.join(back, ["sample", "source_module", "target_module"], "left_semi").select("sample", F.col("w").alias("weight"), F.lit("mutual_import").alias("tag"))

    out = e.alias("e").join(n.select("sample", F.col("id").alias("source"), F.col("module").alias("own")), ["sample", "source"])
    foreign = (F.col("relation") == "CALLS") & ~F.col("target_module").eqNullSafe(F.col("own"))
    sums = out.groupBy("sample", "source").agg(F.count("*").alias("k"), F.count_if(F.col("relation") == "CALLS").alias("calls"), F.count_if(foreign).alias("foreign"))
    own = n.join(sums.withColumnRenamed("source", "id"), ["sample", "id"])
    envy = (F.col("type") == "method") & (F.col("foreign") * 2 > F.col("calls")) & (F.col("calls") > 0)
    marked = own.select("sample", F.col("w").alias("weight"), F.explode(F.array_compact(F.array(
        F.when(F.col("type").isin("class", "module") & (F.col("k") >= GOD), "god_node"), F.when(envy, "feature_envy"),
    ))).alias("tag"))

    rows = whole.unionByName(facts).unionByName(links).unionByName(mutual).unionByName(marked)
    return normalised_weights(rows.where("weight > 0"))
