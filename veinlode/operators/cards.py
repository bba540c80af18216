"""Texts and rows for readers: cards, messages, notes, blind surveys; and references that found graphs are held against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fixed, sigmoid
from ..sources.store import cut
from .resolution import joined

# Wordings of the cards.
RISEN_CYCLE = "True label: 1 (degrading). Within {m} months after the merge, a module this PR touched joined a new import cycle{g}."
RISEN = "True label: 1 (degrading). Over the {m} months after the merge, the modules this PR touched gained dependency links faster than the project's own trend{g}."
STEADY = "True label: 0 (not degrading). Over the {m} months after the merge, the touched modules did not gain links faster than the project trend and joined no new import cycle{g}."
GROWTH = " (excess coupling growth {x} links per module; label 1 above +0.50)"
HISTORY = "EARLIER IN THIS CHAT (for context only; facts must still come from the cards):"
OUTCOMES = {(1, 1): "true positive", (0, 1): "false positive", (0, 0): "true negative", (1, 0): "false negative"}
NOT_PACKAGES = ["tests", "test", "docs", "doc", "examples", "benchmarks", "scripts", "bench", "profiling"]
INTERNAL_TYPES = ["module", "class", "function", "method", "global_variable"]
SCORED_RELATIONS = ["CALLS", "INHERITS", "ACCESSES_GLOBAL"]
EVIDENCE_EDGE = r"([^\s;]+) -> ([A-Z_]+) -> ([^\s;]+) \((-?[0-9.]+)\)"


def filled(template: str, **parts: Column) -> Column:
    """A wording with columns in its marked places."""
    out = F.lit(template)
    for name, value in parts.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def rendered(parts: DataFrame, key: str, skip: Column) -> DataFrame:
    """XR09: (key, diff): the text of a diff again without hunk ``skip`` (null: all stay).

    ``parts`` has (key, place, header, hunk, text), a row per hunk; a file without hunks has one row with a null hunk. A file whose
    only hunks are skipped goes, and a diff of which nothing is left has no row.
    """
    kept = parts.where(~F.coalesce(F.col("hunk") == skip, F.lit(False)))
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("hunk").isNotNull(), F.struct("hunk", "text")))), lambda h: h["text"])
    files = kept.groupBy(key, "place").agg(F.first("header").alias("header"), body.alias("body"))
    text = F.array_join(F.concat(F.array("header"), F.col("body")), "\n")
    whole = F.transform(F.sort_array(F.collect_list(F.struct("place", text.alias("t")))), lambda f: f["t"])
    return files.groupBy(key).agg(F.concat(F.array_join(whole, "\n"), F.lit("\n")).alias("diff"))


def label_text(label: Column, reason: Column, months: Column, excess: Column) -> Column:
    """SX30: a label in words; the growth is left out where it is null."""
    growth = F.coalesce(filled(GROWTH, x=fixed(excess, 2, True)), F.lit(""))
    say = lambda t: filled(t, m=F.coalesce(months, F.lit(6)).cast("string"), g=growth)
    return F.when((label == 1) & (reason == "joined_new_cycle"), say(RISEN_CYCLE)).when(label == 1, say(RISEN)).otherwise(say(STEADY))


def layer_words(structure: Column, diff: Column) -> Column:
    """SX30: what each part did to the score, and which is the larger, if one is."""
    push = lambda x: F.when(x > 0, "pushed the risk up").when(x < 0, "pushed the risk down").otherwise("did not move the risk")
    s, d = fixed(structure, 2, True), fixed(diff, 2, True)
    both = F.concat(F.lit("In words (layer A): the structure part "), push(structure), F.lit(" ("), s, F.lit(") and the diff part "), push(diff), F.lit(" ("), d, F.lit(")."))
    more = " The {p} part is larger ({a} vs {b}), so it had the bigger effect on this score."
    a, b = F.abs(structure), F.abs(diff)
    larger = F.when(b > a, filled(more, p=F.lit("diff"), a=d, b=s)).when(a > b, filled(more, p=F.lit("structure"), a=s, b=d)).otherwise("")
    return F.concat(both, larger)


def user_message(question: Column, cards: Column, history: Column) -> Column:
    """SX23: the cards (array of id, title, text) in order, the last two turns (array of question, answer), then the question."""
    shown = F.transform(cards, lambda c: F.concat(F.lit("["), c["id"], F.lit("] "), c["title"], F.lit("\n"), c["text"]))
    last = F.slice(history, F.greatest(F.size(history) - 1, F.lit(1)), 2)
    said = F.transform(last, lambda t: F.concat(F.lit("Q: "), t["question"], F.lit("\nA: "), t["answer"]))
    past = F.when(F.size(history) > 0, F.concat(F.array(F.lit(HISTORY)), said)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(F.array(F.lit("CARDS:")), shown, past, F.array(F.concat(F.lit("QUESTION: "), question))), "\n\n")


def prediction_lines(rows: DataFrame, threshold: Column) -> DataFrame:
    """XR21: (split, sample_id, line): a line of the predictions card for each row (split, sample_id, label, score), and one of
    totals, with a null sample. Lines stay rows, as a split has no bound."""
    flagged = (F.col("score") >= threshold).cast("int")
    names = F.create_map(*[x for (a, b), n in OUTCOMES.items() for x in (F.lit(f"{a}{b}"), F.lit(n))])
    judged = rows.withColumn("_o", names[F.concat(F.col("label").cast("string"), flagged.cast("string"))])
    line = F.concat(F.col("sample_id").cast("string"), F.lit(": label "), F.col("label"), F.lit(", risk "), fixed(F.col("score"), 3), F.when(flagged == 1, ", risky (").otherwise(", not risky ("), F.col("_o"), F.lit(")"))
    order = ["true positive", "false positive", "true negative", "false negative"]
    each = [F.concat(F.lit(f"{n} "), F.count_if(F.col("_o") == n).cast("string")) for n in order]
    totals = judged.groupBy("split").agg(F.concat(F.lit("Totals: "), F.concat_ws(", ", *each), F.lit(".")).alias("line"))
    return judged.select("split", "sample_id", line.alias("line")).unionByName(totals.withColumn("sample_id", F.lit(None)).select("split", F.col("sample_id").cast(judged.schema["sample_id"].dataType), "line"))


def deck(*parts: DataFrame) -> DataFrame:
    """SX32: the cards of all sources; two of one id are an error, raised as the cards are read."""
    cards = parts[0]
    for p in parts[1:]:
        cards = cards.unionByName(p)
    rest = [x for x in cards.columns if x != "id"]
    one = F.when(F.count("*") == 1, F.first(F.struct(*rest))).otherwise(F.raise_error(F.concat(F.lit("two cards are named "), F.col("id").cast("string"))))
    return cards.groupBy("id").agg(one.alias("_r")).select("id", *[F.col(f"_r.{x}").alias(x) for x in rest])


def predicted_triples(edges: DataFrame, nodes: DataFrame, builtins: Sequence[str]) -> DataFrame:
    """SX33: (path, relation, source, name) of the scored relations, by the file they start in.

    Calls of what is neither a known symbol nor in one of the graph's packages go; a base that is a builtin gets its module's name.
    """
    head = lambda x: F.split(x, r"\.")[0]
    inner = F.coalesce(F.col("_t").isin(INTERNAL_TYPES), F.lit(False))
    ends = nodes.select(F.col("id").alias("target"), F.col("type").alias("_t"), F.col("qualified_name").alias("_n"))
    starts = nodes.select(F.col("id").alias("source"), F.replace("path", F.lit("\\"), F.lit("/")).alias("path"), F.col("qualified_name").alias("_s"))
    # Written first, so that a package of many names can be split; only names that are no symbol look theirs up.
    packages = cut(nodes.where("type = 'module'").select(head(F.col("qualified_name")).alias("_p")).distinct().withColumn("_known", F.lit(True)))
    outer = joined(ends.where(~inner).withColumn("_p", head(F.col("_n"))), packages, ["_p"], "left").drop("_p")
    ends = ends.where(inner).withColumn("_known", F.lit(True)).unionByName(outer)
    rows = joined(joined(edges.where(F.col("type").isin(SCORED_RELATIONS)), starts, ["source"]), ends, ["target"])
    rows = rows.where((F.col("type") != "CALLS") | F.col("_known").isNotNull())
    name = F.when((F.col("type") == "INHERITS") & ~inner & F.col("_n").isin(list(builtins)), F.concat(F.lit("builtins."), F.col("_n"))).otherwise(F.col("_n"))
    return rows.select("path", F.col("type").alias("relation"), F.col("_s").alias("source"), name.alias("name")).distinct()


def dotted_prefixes(name: Column) -> Column:
    """a.b.c to a, a.b and a.b.c."""
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def with_inner(pairs: DataFrame, modules: DataFrame, by: str, ends: Sequence[str]) -> DataFrame:
    """``pairs`` with ``inner``: whether both ends are one of the program's modules or lie in one. ``modules``: (by, module)."""
    out = pairs
    for i, end in enumerate(ends):
        # Each end looks up its own dotted prefixes, so that a program's modules aren't compared with all its names.
        names = out.select(by, F.col(end).alias(f"_e{i}")).distinct()
        known = names.select(by, f"_e{i}", F.explode(dotted_prefixes(F.col(f"_e{i}"))).alias("module"))
        known = known.join(modules.select(by, "module").distinct(), [by, "module"]).select(by, F.col(f"_e{i}").alias(end)).distinct().withColumn(f"_k{i}", F.lit(True))
        out = out.join(known, [by, end], "left")
    inner = F.lit(True)
    for i in range(len(ends)):
        inner = inner & F.col(f"_k{i}").isNotNull()
    return out.withColumn("inner", inner).drop(*[f"_k{i}" for i in range(len(ends))])


def gold_edges(callgraph: DataFrame, modules: DataFrame, by: str) -> DataFrame:
    """SX34: (by, caller, callee, inner) of call graphs (by, caller, callees); pairs that aren't inner are the external ones."""
    return with_inner(callgraph.select(by, "caller", F.explode("callees").alias("callee")), modules, by, ["caller", "callee"])


def shared_only(found: DataFrame, scanned: DataFrame, by: str, ends: Sequence[str]) -> DataFrame:
    """SX36: pairs both of whose ends the other tool scanned too; ``scanned``: (by, module)."""
    for end in ends:
        found = found.join(scanned.select(by, F.col("module").alias(end)).distinct(), [by, end], "left_semi")
    return found


def source_layout(files: DataFrame) -> DataFrame:
    """SX37: (repo, root, packages): of each repository (repo, path) the folder ``src`` if packages lie in it, else the top."""
    parts = F.split("path", "/")
    inner, outer = (F.size(parts) == 3) & (parts[0] == "src"), F.size(parts) == 2
    rows = files.where(parts[F.size(parts) - 1] == "__init__.py").select("repo", F.when(inner, "src").when(outer, ".").alias("root"), F.when(inner, parts[1]).otherwise(parts[0]).alias("name"))
    rows = rows.where(F.col("root").isNotNull() & ~F.col("name").isin(NOT_PACKAGES) & F.col("name").rlike("^[A-Za-z_][A-Za-z0-9_]*$"))
    found = rows.groupBy("repo", "root").agg(F.array_sort(F.collect_set("name")).alias("packages"))
    return found.groupBy("repo").agg(F.max_by(F.struct("root", "packages"), F.col("root")).alias("r")).select("repo", "r.root", "r.packages")


def context(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SX46: the later graph's edges with ``known``: whether the earlier one has them."""
    return after.join(before.select(*keys).distinct().withColumn("known", F.lit(True)), list(keys), "left").withColumn("known", F.coalesce("known", F.lit(False)))


def pr_label(number: Column, split: Column, label: Column, score: Column, threshold: Column, explained: Column) -> Column:
    """SX47: a row's short title in lists."""
    right = (score >= threshold).cast("int") == label
    return F.concat(
        F.lit("#"), number.cast("string"), F.lit(" · "), split, F.when(label == 1, " · risky").otherwise(" · safe"), F.lit(" · risk "), fixed(score, 3),
        F.when(right, " · correct").otherwise(" · WRONG"), F.when(explained, " · explained").otherwise(""),
    )


def layer_a(rows: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """SX47: (key, part, logit, direction) of the named contributions of each row."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("part"), F.col(x).alias("v")) for x, n in names.items()])).alias("e")
    return rows.select(key, each).select(key, "e.part", F.round("e.v", 3).alias("logit"), F.when(F.col("e.v") >= 0, "pushes risk up").otherwise("pushes risk down").alias("direction"))


def valid_documents(texts: DataFrame, value: str, fields: str, schema: str) -> DataFrame:
    """SX48: the documents (``doc``) of JSON texts that parse and have the wanted ``schema`` value; others are left out."""
    doc = F.from_json(value, f"schema string, {fields}", {"mode": "PERMISSIVE"})
    return texts.withColumn("doc", doc).where(F.col("doc.schema") == schema)


def evidence_text(summary: Column) -> Column:
    """SX52: a summary's title, score with its verdict, and first three edges as lines of plain English; missing parts are left out, all of them where it is null."""
    title, score = r"PR: (.*?)\. Risk score", r"Risk score ([0-9.]+) \(threshold ([0-9.]+)\)"
    has = lambda p: F.regexp_like(summary, F.lit(p))
    risk, limit = (F.regexp_extract(summary, score, i).try_cast("double") for i in (1, 2))
    flagged = F.when(risk >= limit, "flags it as likely to increase coupling").otherwise("does not flag it")
    verdict = F.concat(F.lit("The model's risk score is "), fixed(risk, 4), F.lit(" (threshold "), fixed(limit, 4), F.lit("), so it "), flagged, F.lit("."))
    part = lambda i: F.regexp_extract_all(summary, F.lit(EVIDENCE_EDGE), F.lit(i))
    short = lambda x: F.regexp_replace(x, "^[^:]*:", "")
    edges = F.slice(F.arrays_zip(part(1).alias("a"), part(2).alias("r"), part(3).alias("b"), part(4).alias("w")), 1, 3)
    lines = F.transform(edges, lambda e: F.concat(F.lit("  - "), short(e["a"]), F.lit(" "), e["r"], F.lit(" "), short(e["b"]), F.lit(" ("), fixed(e["w"].cast("double"), 3, True), F.lit(")")))
    head = F.lit("Dependencies with the most influence on the score (+ pushes risk up, - pushes it down):")
    listed = F.when(F.size(lines) > 0, F.concat(F.array(head), lines))
    one = F.array(F.when(has(title), F.concat(F.lit("Title: "), F.regexp_extract(summary, title, 1))), F.when(has(score), verdict))
    return F.array_join(F.concat(F.array_compact(one), F.coalesce(listed, F.array().cast("array<string>"))), "\n")


def blind_survey(answers: DataFrame, modes: Sequence[str], n: int, seed: str) -> DataFrame:
    """SX52: (sample_id, letter, mode, explanation): the ``n`` samples first in hash order that every mode has an answer for, the
    modes of each under letters in hash order. ``n`` is the size of the survey; answers has (sample_id, mode, explanation)."""
    ready = answers.where(F.col("mode").isin(list(modes)) & (F.trim("explanation") != ""))
    whole = ready.groupBy("sample_id").agg(F.countDistinct("mode").alias("_n")).where(F.col("_n") == len(modes))
    order = lambda *p: F.sha2(F.concat_ws(":", F.lit(seed), *[F.col(x).cast("string") for x in p]), 256)
    chosen = whole.orderBy(order("sample_id"), "sample_id").limit(n).select("sample_id")
    place = F.row_number().over(Window.partitionBy("sample_id").orderBy(order("sample_id", "mode"), "mode"))
    return ready.join(chosen, "sample_id").select("sample_id", F.char(place + 64).alias("letter"), "mode", "explanation")


def warnings(rows: DataFrame, results: DataFrame, model: str, baseline: str) -> DataFrame:
    """SX53: (split, note): splits (split, label) with under 3 safe rows, a test split of under 30, and a model whose average
    precision on test isn't above the baseline's; ``results``: (name, ap)."""
    counts = rows.groupBy("split").agg(F.count_if(F.col("label") == 0).alias("safe"), F.count("*").alias("n"))
    few = F.when(F.col("safe") < 3, F.concat(F.col("split"), F.lit(" has only "), F.col("safe").cast("string"), F.lit(" safe (label 0) PR(s); its scores are not reliable.")))
    small = F.when((F.col("split") == "test") & (F.col("n") < 30), F.concat(F.lit("Only "), F.col("n").cast("string"), F.lit(" test PRs: use the bootstrap ranges, not single numbers.")))
    notes = counts.select("split", F.explode(F.array_compact(F.array(few, small))).alias("note"))
    ap = lambda name: F.max(F.when(F.col("name") == name, F.col("ap")))
    chance = results.agg((ap(model) <= ap(baseline)).alias("_w")).where("_w")
    return notes.unionByName(chance.select(F.lit("test").alias("split"), F.lit("Fusion does not rank test PRs better than chance (PR-AUC <= share of risky PRs).").alias("note")))


def skip_reason(files: Column, future: Column, merge: Column, touched: Column, label_reason: Column, label: Column) -> Column:
    """LB13: why a change set gives no sample, the first reason that holds; null where it gives one."""
    return (
        F.when(F.coalesce(F.size(files), F.lit(0)) <= 0, "no production Python change")
        .when(future.isNull() | (future == merge), "no later snapshot for the outcome window")
        .when(F.coalesce(F.size(touched), F.lit(0)) <= 0, "changed files are not analysed project modules")
        .when(label.isNull(), label_reason)
    )


def weighted_mean(windows: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """FE15: (key, vector): the mean of each key's window vectors, weighted by their tokens; coordinates are summed apart."""
    parts = windows.select(key, F.col(weight).alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    mean = parts.groupBy(key, "_i").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_m"))
    return mean.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda p: p["_m"]).alias(vector))


def scored(rows: DataFrame, features: str, scaler: Sequence[tuple[float, float]], weights: Sequence[float], bias: float) -> DataFrame:
    """ML12: ``rows`` with ``score``: given weights on log features, scaled as in training."""
    z = F.lit(float(bias))
    for i, ((mean, std), w) in enumerate(zip(scaler, weights, strict=True)):
        z = z + (F.log1p(F.col(features)[i]) - mean) / std * w
    return rows.withColumn("score", sigmoid(z))


def export_problems(vectors: DataFrame, samples: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """ML14: (key, problem) before vectors are handed off: a kept sample without one, one of a purged or unknown sample, another
    width, or a value that isn't finite. ``samples``: (key, split)."""
    both = samples.withColumn("_s", F.lit(True)).join(vectors.withColumn("_v", F.lit(True)), key, "full_outer")
    kept = F.coalesce(F.col("split") != "purged", F.lit(False))
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    problem = F.when(kept & F.col("_v").isNull(), "missing").when(F.col("_v") & ~kept, "surplus").when(F.size(vector) != width, "width").when(~finite, "not finite")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")
