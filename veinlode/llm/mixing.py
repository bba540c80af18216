"""Mixing sources to target weights by fixed-length blocks.

Each source's words, its documents laid end to end in a fixed order, are packed into blocks of
``block_words``. The mix needs a known number of blocks per source; every output shard draws its
source counts from a multinomial over what is still owed, and the last shard takes the rest, so
the totals are met exactly. The k-th slot of a source reads the block at place k mod N of a
pseudorandom permutation of its N blocks, another one in each pass (a keyed Feistel network with
cycle walking), so no block is read more than ``max_passes`` times. Slots and pieces of documents
are joined by block index.

Targets: sources share all words by weight; a target stops at ``max_passes`` times its source's
size, and the excess is shared again by weight.

Bounds: the driver holds one row per source and shard, and refuses more than ``max_sources``
sources. Positions come from sums over ``BUCKETS`` buckets of each source, so no task sorts a
whole source. Copies of a row are counted before they move.

Defined cases: null text has size 0 and takes nothing; the null source is one source, the last;
repeated rows are laid out one after another, each on its own; a source without words has target 0;
an empty table gives an empty mix.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SPACE, fresh, map_batches, materialise, need

BUCKETS = 1024
WORD = re.compile(rf"[^{SPACE}]+")


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    weight: float
    target: float


def targets(sizes: list[tuple[str | None, int]], weight_of: Callable[[int, str | None], float], passes: int) -> list[Source]:
    """Sources by code point, null last, with their targets."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weights = [weight_of(i, name) for i, (name, _) in enumerate(ordered)]
    goal = [0.0] * len(ordered)
    open_ = [i for i, (_, n) in enumerate(ordered) if n and weights[i] > 0]
    rest = float(sum(n for _, n in ordered))
    while open_:
        unit = rest / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > passes * ordered[i][1]]
        for i in full or open_:
            goal[i] = float(passes * ordered[i][1]) if full else unit * weights[i]
        if not full:
            break
        rest -= sum(goal[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return [Source(name, n, w, t) for (name, n), w, t in zip(ordered, weights, goal)]


def draws(owed: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Blocks of each source per shard: multinomial over what is owed, the last shard taking the rest."""
    rng = np.random.default_rng(seed)
    owed = owed.astype(np.int64).copy()
    out = np.zeros((shards, len(owed)), dtype=np.int64)
    for j in range(shards):
        wanted = -(-int(owed.sum()) // (shards - j))
        got = np.minimum(rng.multinomial(wanted, owed / owed.sum()), owed) if wanted else np.zeros_like(owed)
        for i in np.argsort(got - owed, kind="stable"):  # what clipping left over, from the source owed most
            more = min(int(wanted - got.sum()), int(owed[i] - got[i]))
            got[i] += more
        out[j] = got
        owed -= got
    return out


def permuted(k: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Place of each index k in [0, n) under the permutation that ``key`` names."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        h, m, x = half[todo], mask[todo], out[todo]
        left, right = x >> h, x & m
        for r in range(rounds):
            f = (right + key[todo]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((r * 0xBF58476D1CE4E5B9) % 2**64)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(29))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


@dataclass(frozen=True)
class Mix:
    """``rows``: each document's (key, source_no, size, copy, start); ``taken``: its pieces that the mix reads
    (key, copy, shard, slot, pass, first word, words); key columns are doc_id and text_hash."""

    sources: list[Source]
    rows: DataFrame
    taken: DataFrame


KEY = ["doc_id", "text_hash", "source_no", "size"]


def mix(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight_of: Callable[[int, str | None], float] = lambda i, name: float(i % 3 + 1),
    block_words: int = 64,
    max_passes: int = 3,
    shards: int = 64,
    seed: int = 11,
    max_sources: int = 100_000,
) -> Mix:
    need(docs, doc_id, text, source)
    spark = docs.sparkSession
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(rf"[^{SPACE}]+"), F.lit(0))), F.lit(0)).cast("long")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{source}`").alias("source"), size.alias("size")
    )
    rows = materialise(rows.groupBy("doc_id", "text_hash", "source", "size").agg(F.count("*").alias("copies")))
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources; weights are set per source")
    sources = targets([(r.source, r["size"]) for r in sums], weight_of, max_passes)
    n_blocks = np.array([-(-s.size // block_words) for s in sources], dtype=np.int64)
    owed = np.array([min(max_passes * int(n), round(s.target * int(n) / s.size)) if s.size else 0 for s, n in zip(sources, n_blocks)], dtype=np.int64)

    kind = docs.schema[source].dataType
    known = spark.createDataFrame(
        [(i, s.name) for i, s in enumerate(sources)],
        T.StructType([T.StructField("source_no", T.IntegerType()), T.StructField("source_name", kind)]),
    )
    # One row per source, at most max_sources of them.
    rows = rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name", "source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(BUCKETS)).cast("int"))
    sums = rows.groupBy("source_no", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    rows = rows.join(offsets, ["source_no", "bucket"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    rows = rows.select(*KEY, "copy", (F.col("offset") + F.col("start") + F.col("copy") * F.col("size")).alias("start"))
    rows = materialise(rows)

    block = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))
    pieces = rows.where("size > 0").select(*KEY, "copy", "start", block.alias("block"))
    first = F.greatest(F.lit(0), F.col("block") * block_words - F.col("start"))
    past = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("start"))
    pieces = pieces.select(*KEY, "copy", "block", first.alias("first"), (past - first).alias("words"))

    # Slots are listed from a small table, whose size says nothing about theirs: never broadcast them.
    listed = slots(spark, draws(owed, shards, seed), n_blocks, seed)
    taken = listed.hint("merge").join(pieces.hint("merge"), ["source_no", "block"])
    return Mix(sources, rows, taken.select(*KEY, "copy", "shard", "slot", "pass", "first", "words"))


def slots(spark, counts: np.ndarray, n_blocks: np.ndarray, seed: int, chunk: int = 1 << 16, per_task: int = 1 << 19) -> DataFrame:
    """(shard, source_no, slot, pass, block) of all slots; ranges are cut into chunks, and these dealt to tasks, before
    they are listed. The number of tasks is given, as adaptive execution would put so few rows into one."""
    begun = np.concatenate((np.zeros((1, counts.shape[1]), dtype=np.int64), counts.cumsum(0)))[:-1]
    rows = [
        (j, i, int(begun[j, i]), int(counts[j, i]), int(n_blocks[i]))
        for j in range(counts.shape[0])
        for i in range(counts.shape[1])
        if counts[j, i]
    ]
    ranges = spark.createDataFrame(rows, "shard int, source_no int, begun long, n long, blocks long")
    at = ranges.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long"))))
    at = at.repartition(max(1, -(-int(counts.sum()) // per_task)), "shard", "source_no", "at")
    slot = F.explode(F.sequence(F.col("begun") + F.col("at"), F.col("begun") + F.least(F.col("at") + chunk, F.col("n")) - 1))
    listed = at.select("shard", "source_no", "blocks", slot.alias("slot"))

    def make() -> Callable:
        def work(batch: dict) -> tuple[list, None]:
            k, n, source = (batch[c].to_numpy(zero_copy_only=False) for c in ("slot", "blocks", "source_no"))
            turn = k // n
            key = (source.astype(np.uint64) * np.uint64(1_000_003) + turn.astype(np.uint64)) * np.uint64(2_654_435_761) + np.uint64(seed)
            return [pa.array(turn.astype(np.int32)), pa.array(permuted(k % n, n, key))], None

        return work

    inputs = {c: listed[c] for c in ("slot", "blocks", "source_no")}
    return map_batches(listed, inputs, ["shard", "source_no", "slot"], [("pass", T.IntegerType()), ("block", T.LongType())], make, rows=1 << 16)


def mixed_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", **options) -> DataFrame:
    """The mix as documents: a row for each document and pass, with the words that pass takes from it, runs of
    them as they stand in the text, joined by a newline. A pass that takes all words has the text unchanged.

    Columns are those of ``docs``; ``n_chars``, where there is such a column, is counted anew.
    """
    made = mix(docs, doc_id=doc_id, text=text, source=source, **options)
    parts = made.taken.groupBy("doc_id", "text_hash", "copy", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("parts"))
    parts = parts.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("copy", "pass", "parts"))).alias("_turns"))
    parts = parts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_turns")
    key, own = docs[f"`{doc_id}`"], F.xxhash64(docs[f"`{text}`"])
    wide = docs if made.rows.where("copy > 0").isEmpty() else docs.dropDuplicates()
    wide = wide.join(parts, key.eqNullSafe(F.col("_id")) & (own == F.col("_hash")))
    others = [c for c in docs.columns if c not in (text, n_chars)]

    def slices(value: str, turns: list) -> list[str]:
        spans, out = None, []
        for turn in turns:
            runs: list[list[int]] = []
            for part in turn["parts"]:
                if runs and runs[-1][1] == part["first"]:
                    runs[-1][1] += part["words"]
                else:
                    runs.append([part["first"], part["first"] + part["words"]])
            spans = spans or [m.span() for m in WORD.finditer(value)]
            whole = len(runs) == 1 and runs[0] == [0, len(spans)]
            out.append(value if whole else "\n".join(value[spans[a][0] : spans[b - 1][1]] for a, b in runs))
        return out

    def make() -> Callable:
        def work(batch: dict) -> tuple[list, list[int]]:
            texts, at = [], []
            for i, (value, turns) in enumerate(zip(batch["text"].to_pylist(), batch["turns"].to_pylist())):
                made = slices(value, turns)
                texts += made
                at += [i] * len(made)
            return [texts], at

        return work

    name = fresh("mixed", others)
    done = map_batches(wide, {"text": wide[f"`{text}`"], "turns": wide["_turns"]}, others, [(name, T.StringType())], make)
    new = F.col(f"`{name}`")
    sized = {text: new, n_chars: F.length(new).cast(docs.schema[n_chars].dataType) if n_chars in docs.columns else None}
    return done.select(*[sized[c].alias(c) if c in sized else F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    made = mix(docs)
    got = made.taken.groupBy(*KEY, "copy").agg(F.sum("words").alias("taken"))
    kept = docs.sparkSession.createDataFrame(
        [(i, s.size, s.target) for i, s in enumerate(made.sources)], "source_no int, source_size long, target double"
    )
    both = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*KEY, "copy"]]
    rows = made.rows.alias("a").join(got.alias("b"), both, "left").select("a.doc_id", "a.size", "a.source_no", F.coalesce("b.taken", F.lit(0)).alias("taken"))
    return rows.join(F.broadcast(kept), "source_no").select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
