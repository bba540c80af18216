"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark text (questions and answers) is normalised to words; each run of ``window``
consecutive words is one pattern, and an item of fewer words is one pattern as a whole. All
patterns go into a single automaton. A document is normalised the same way and scanned once;
what matches is mapped back to code-point offsets in the original text.

Defined cases: null or empty text has no words and no hit; a null item text, or one without
words, gives no pattern; items that share a passage are all reported; repeated items count once
per distinct id; rows with a null id hit like any other, count together as one item, and are left
out of ``item_ids``; repeated documents are judged each by itself; an empty benchmark hits nothing.

Memory: an automaton takes some 450 bytes per byte of benchmark text. A benchmark above
``max_pattern_bytes`` is cut into blocks below that bound (a longer item at words, with the overlap of
a window), so that a task holds one automaton at a time, made once. The driver holds one block
at a time. Each block is a pass over the documents, whose hits so far are written and reread in between;
hits are united per document, so the number of blocks changes no result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, map_batches, materialise, need

#: A-Z to a-z, 0-9 and bytes from 0x80 (parts of code points beyond ASCII) kept, all else a space.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(NORMAL).split() if raw else []


def patterns_of(items: list[tuple[str | None, bytes]], window: int) -> dict[str, tuple[int, list[str | None]]]:
    """Pattern text, with a space on both sides, to (its words, the items that have it)."""
    found: dict[str, tuple[int, dict[str | None, None]]] = {}
    for item, raw in items:
        words = words_of(raw)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            part = words[at : at + window]
            key = f" {b' '.join(part).decode('utf-8', 'replace')} "
            found.setdefault(key, (len(part), {}))[1][item] = None
    return {key: (n, list(ids)) for key, (n, ids) in found.items()}


def automaton(patterns: dict[str, tuple[int, list[str | None]]]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for key, value in patterns.items():
        made.add_word(key, value)
    if len(made):
        made.make_automaton()
    return made


Runs = list[tuple[int, int]]


def scan(tree: ahocorasick.Automaton, words: list[bytes]) -> tuple[Runs, set[str | None]]:
    """Runs [first, past) of hit words, and the items whose windows occur."""
    if not words or not len(tree):
        return [], set()
    texts = [w.decode("utf-8", "replace") for w in words]
    hits = list(tree.iter(f" {' '.join(texts)} "))
    if not hits:
        return [], set()
    ends = np.cumsum([len(t) + 1 for t in texts])  # index of the space after each word
    last = np.searchsorted(ends, [end for end, _ in hits])
    return [(int(k) - n + 1, int(k) + 1) for k, (_, (n, _)) in zip(last, hits)], {i for _, (_, ids) in hits for i in ids}


def united(runs: Runs) -> Runs:
    """Maximal runs in order."""
    out: list[list[int]] = []
    for first, past in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past])
    return [(a, b) for a, b in out]


def spans_of(raw: bytes, runs: Runs) -> list[dict]:
    """Runs of words as code-point offsets in the text."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(NORMAL))]
    spans, at, seen = [], 0, 0
    for first, past in runs:
        bounds = []
        for byte in (places[first][0], places[past - 1][1]):
            seen += len(raw[at:byte].decode("utf-8", "replace"))
            at = byte
            bounds.append(seen)
        spans.append({"start": bounds[0], "end": bounds[1]})
    return spans


def parts_of(raw: bytes, window: int, bound: int) -> list[bytes]:
    """``raw``, or its words in parts of about ``bound`` bytes that together have the same windows."""
    words = words_of(raw) if len(raw) > bound else []
    if len(words) <= window:
        return [raw]
    each = max(window, len(words) * bound // len(raw))
    return [b" ".join(words[at : at + each + window - 1]) for at in range(0, len(words) - window + 1, each)]


def blocks_of(benchmark: DataFrame, item_id: str, text: str, window: int, bound: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks below the bound (or of one window), streamed through the driver; one block at least."""
    rows = (
        benchmark.where(F.col(f"`{text}`").isNotNull())
        .select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{text}`").cast("binary").alias("t"))
        .distinct()
        .toLocalIterator()
    )
    block: list[tuple[str | None, bytes]] = []
    held = 0
    for row in rows:
        for part in parts_of(bytes(row.t), window, bound):
            if block and held + len(part) > bound:
                yield block
                block, held = [], 0
            block.append((row.i, part))
            held += len(part)
    yield block


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
STATE = {"_runs": T.ArrayType(T.ArrayType(T.IntegerType())), "_items": T.ArrayType(T.StringType()), "_unnamed": T.BooleanType()}
FOUND = {"n_words": T.LongType(), "n_hit": T.LongType(), "n_items": T.LongType(), "item_ids": T.ArrayType(T.StringType()), "spans": SPAN}


def one_pass(docs: DataFrame, text: str, keep: list[str], block: list, window: int, before: list[str], last: bool) -> DataFrame:
    """``keep`` and the hits so far (runs of words, item ids, whether a null item hit), or at ``last`` the results.

    ``before`` names the columns of the hits of the passes before; it is empty in the first.
    """
    sent = docs.sparkSession.sparkContext.broadcast(block)
    fields = FOUND if last else STATE
    inputs = {"raw": docs[f"`{text}`"].cast("binary")} | {n: docs[f"`{c}`"] for n, c in zip(STATE, before)}

    def make() -> Callable:
        tree = automaton(patterns_of(sent.value, window))

        def work(batch: dict) -> tuple[list, None]:
            texts = batch["raw"].to_pylist()
            old = zip(*(batch[n].to_pylist() for n in STATE)) if before else [([], [], False)] * len(texts)
            out = []
            for raw, (runs, items, unnamed) in zip(texts, old):
                words = words_of(raw)
                more, ids = scan(tree, words)
                runs = united([*map(tuple, runs), *more])
                items, unnamed = sorted({*items, *(ids - {None})}), unnamed or None in ids
                hit = sum(b - a for a, b in runs)
                out.append((len(words), hit, len(items) + unnamed, items, spans_of(raw, runs) if runs else []) if last else (runs, items, unnamed))
            return [list(c) for c in zip(*out)] if out else [[]] * len(fields), None

        return work

    return map_batches(docs, inputs, keep, [(fresh(n, keep), kind) for n, kind in fields.items()], make)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    keep: list[str] | None = None,
    window: int = 10,
    max_pattern_bytes: int = 1 << 20,
) -> DataFrame:
    """``keep`` columns (default: all) and ``n_words, n_hit, n_items, item_ids, spans`` per document; new names that
    clash with kept ones get an underscore.

    ``spans`` are maximal runs of hit words, as code-point offsets in the original text, end exclusive.
    """
    need(docs, text)
    need(benchmark, item_id, item_text)
    keep = docs.columns if keep is None else keep
    between = [*keep, *({text} - set(keep))]
    blocks = blocks_of(benchmark, item_id, item_text, window, max_pattern_bytes)
    block, after = next(blocks), next(blocks, None)
    before: list[str] = []
    while after is not None:
        docs = materialise(one_pass(docs, text, between, block, window, before, False))
        before = docs.columns[-len(STATE) :]
        block, after = after, next(blocks, None)
    return one_pass(docs, text, keep, block, window, before, True)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with their columns as they were."""
    found = find_leaks(docs, benchmark, **options)
    n_hit = fresh("n_hit", docs.columns)
    return found.where(F.col(f"`{n_hit}`") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_leaks(docs.select("doc_id", "text"), benchmark, keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
