"""Scoring of answers, retrieval with pinned cards, enriched attributions, and tables of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import plain_dashes, sigmoid

# Phrases by which an answer says that it doesn't know.
REFUSALS = ("don't have", "do not have", "not in the project outputs", "no information", "cannot answer", "can't answer", "not available in")


def score_answers(items: DataFrame) -> DataFrame:
    """EV18: (id, topic, retrieval, facts, grounded, refusal_ok, passed) of each answered question.

    ``items``: (id, topic, expect_cards, must_include: array of groups of phrases, refuse, text, cards, grounded). A
    group counts if one of its phrases is in the answer; no group counts as all.
    """
    plain = lambda x: F.trim(F.lower(plain_dashes(x)))
    text = plain(F.coalesce("text", F.lit("")))
    none, groups = F.array().cast("array<string>"), F.coalesce("must_include", F.array().cast("array<array<string>>"))
    missing = F.size(F.filter(groups, lambda g: ~F.exists(g, lambda p: F.contains(text, plain(p)))))
    facts = F.when(F.size(groups) == 0, 1.0).otherwise((F.size(groups) - missing) / F.size(groups))
    found = F.size(F.array_except(F.coalesce("expect_cards", none), F.coalesce("cards", none))) == 0
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused |= F.contains(text, F.lit(phrase))
    fine = ~F.coalesce("refuse", F.lit(False)) | refused
    grounded = F.coalesce("grounded", F.lit(True))
    return items.select("id", "topic", found.alias("retrieval"), facts.alias("facts"), grounded.alias("grounded"), fine.alias("refusal_ok"), (found & (missing == 0) & grounded & fine).alias("passed"))


def summary(scored: DataFrame, topic: str = "off-topic") -> DataFrame:
    """EV18: one row of rates over all questions, and of right refusals of those of a topic."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    off = F.col("topic") == topic
    return scored.agg(
        F.count("*").alias("questions"), share("retrieval").alias("hit_rate"), share("facts").alias("fact_accuracy"), share("grounded").alias("grounded_rate"),
        F.count_if(off & F.col("refusal_ok")).alias("right_refusals"), F.count_if(off).alias("refusals"), F.count_if("passed").alias("passed"),
    )


def question_problems(questions: DataFrame) -> DataFrame:
    """SX25: (id, problem) of questions (id, position, follow_up_of) whose id isn't unique, or whose parent isn't an earlier one."""
    twice = questions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem"))
    parents = questions.groupBy(F.col("id").alias("follow_up_of")).agg(F.min("position").alias("_at"))
    late = questions.where("follow_up_of IS NOT NULL").join(parents, "follow_up_of", "left").where("_at IS NULL OR _at >= position")
    return twice.unionByName(late.select("id", F.lit("parent").alias("problem")))


def table_rows(scored: DataFrame, questions: DataFrame) -> DataFrame:
    """SX26: (id, row): a Markdown row of each scored question."""
    yes = lambda c: F.when(F.col(c), "yes").otherwise("NO")
    cells = ["id", F.col("question"), yes("retrieval"), F.format_string("%.0f%%", F.bround(F.col("facts") * 100, 0)), yes("grounded"), yes("passed")]
    return scored.join(questions.select("id", "question"), "id").select("id", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("row"))


def with_pinned(pinned: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """XR16, WN15: (question, card, place) of what is sent: pinned cards first, then the best found ones within limits.

    ``pinned``: (question, card, is_pr, position). ``found``: (question, card, is_pr, score, position), scores above 0
    only. A question with a pinned change set takes two more cards at most, and no further change set; others take k
    in all, and one change set at most; a question whose pinned cards fill k takes no more.
    """
    first = pinned.groupBy("question", "card").agg(F.min("position").alias("position"), F.max("is_pr").alias("is_pr"))
    own = Window.partitionBy("question").orderBy("position", "card")
    head = first.select("question", "card", F.row_number().over(own).alias("place"))
    n = first.groupBy("question").agg(F.count("*").alias("_n"), F.max("is_pr").alias("_pr"))
    rest = found.join(first.select("question", "card"), ["question", "card"], "left_anti").join(n, "question", "left")
    rest = rest.select("*", F.coalesce("_n", F.lit(0)).alias("_have"), F.coalesce("_pr", F.lit(False)).alias("_named"))
    best = Window.partitionBy("question").orderBy(F.desc("score"), "position", "card")
    nth = F.sum(F.col("is_pr").cast("int")).over(best.rowsBetween(Window.unboundedPreceding, 0))
    allowed = rest.withColumn("_nth", nth).where(~F.col("is_pr") | (~F.col("_named") & (F.col("_nth") == 1)))
    room = F.greatest(F.lit(k), F.col("_have"))
    limit = F.when(F.col("_named"), F.least(room, F.col("_have") + 2)).otherwise(room)
    tail = allowed.withColumn("place", F.row_number().over(best) + F.col("_have")).where(F.col("place") <= limit)
    return head.unionByName(tail.select("question", "card", "place"))


def ranked_edges(edges: DataFrame, before: DataFrame, touched: DataFrame, k: int) -> DataFrame:
    """XR06: the k edges (sample, src, dst, relation, attribution) of each sample with the largest absolute attribution, with
    ``added`` (the snapshot before hasn't it) and whether its ends are touched."""
    from .temporal import ranked_cut

    top = ranked_cut(edges, ["sample"], [F.desc(F.abs("attribution")), F.asc("src"), F.asc("dst"), F.asc("relation")], k)
    old = before.select("sample", "src", "dst", "relation").distinct().withColumn("_old", F.lit(True))
    out = top.join(old, ["sample", "src", "dst", "relation"], "left").withColumn("added", F.col("_old").isNull()).drop("_old")
    for end in ("src", "dst"):
        marked = touched.select("sample", F.col("node").alias(end)).distinct().withColumn(f"touched_{end}", F.lit(True))
        out = out.join(marked, ["sample", end], "left").withColumn(f"touched_{end}", F.coalesce(f"touched_{end}", F.lit(False)))
    return out


def without_each(parts: DataFrame, sample: str, hunk: str, value: str, order: list[Column], cap: int = 20) -> DataFrame:
    """XR08: (sample, hunk, effect): how far the score, the sigmoid of the sum of a sample's parts, falls without each of its
    ``cap`` first hunks in the given order. The cap is the report's own; sums are over all parts."""
    from .temporal import ranked_cut

    s = parts.groupBy(sample, hunk).agg(F.sum(value).alias("_own"), *[F.first(c).alias(f"_o{i}") for i, c in enumerate(order)])
    total = s.withColumn("_all", F.sum("_own").over(Window.partitionBy(sample)))
    top = ranked_cut(total, [sample], [F.asc(f"_o{i}") for i in range(len(order))] + [F.asc(hunk)], cap)
    return top.select(sample, hunk, (sigmoid(F.col("_all")) - sigmoid(F.col("_all") - F.col("_own"))).alias("effect"))


def node_gradients(nodes: DataFrame, weight: Column, value: Column, steps: int) -> DataFrame:
    """XR02: ``nodes`` with the integrated gradient of sigmoid(weight * value) along the line from 0 to value, by the midpoint
    rule: the mean gradient over ``steps`` points, times the value."""
    at = lambda i: sigmoid(weight * value * ((i - 0.5) / steps))
    mean = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda a, i: a + at(i) * (1 - at(i)) * weight) / steps
    return nodes.withColumn("attribution", mean * value)


def adaptive_gradients(nodes: DataFrame, key: str, weight: Column, value: Column, steps: int = 4, most: int = 512) -> tuple[DataFrame, int]:
    """XR10: ``node_gradients`` with the steps doubled until, over all samples, the attributions of each add up to the change of
    its score within the larger of 0.01 and 2 % of it, or ``most`` steps are taken; and those steps."""
    change = sigmoid(weight * value) - 0.5
    while True:
        out = node_gradients(nodes.withColumn("_change", change), weight, value, steps)
        s = out.groupBy(key).agg(F.sum("attribution").alias("a"), F.sum("_change").alias("c"))
        off = s.where(F.abs(F.col("a") - F.col("c")) > F.greatest(F.lit(0.01), 0.02 * F.abs("c")))
        if steps >= most or off.isEmpty():
            return out.drop("_change"), steps
        steps *= 2


def best_baseline(scores: DataFrame, model: str) -> DataFrame:
    """EV22: (by, baseline, baseline_ap, ap, verdict): whether a model's average precision beats the best other one's. ``scores``:
    (by, model, ap); of equal ones the first by name is the best."""
    rest = scores.where(F.col("model") != model).groupBy("by").agg(F.min(F.struct((-F.col("ap")).alias("n"), "model")).alias("_b"))
    both = scores.where(F.col("model") == model).join(rest, "by", "left")
    ap = -F.col("_b.n")
    return both.select("by", F.col("_b.model").alias("baseline"), ap.alias("baseline_ap"), "ap", F.when(F.col("ap") > F.coalesce(ap, F.lit(-1.0)), "beats").otherwise("does not beat").alias("verdict"))
