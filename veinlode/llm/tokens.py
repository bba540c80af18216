"""Token counts with a whole-token shortcut.

Most pre-tokens of running text are themselves entries of the vocabulary. ``prove`` finds, once
and before any text is read, the vocabulary strings for which the library returns exactly one
token when they stand alone as a pre-token; their occurrences count 1 each without merging. Only
the other distinct pre-tokens of a batch are merged, all at once in arrays, with a bounded cache.

The pre-token pattern runs in another engine than the library's. A character is trusted only
after the library has cut probe strings around it at the same places; a text with any other
character is encoded as a whole by the library, and so are all texts when the tokenizer is of
another kind than the merges here cover. Counts are therefore the library's in every case.

Defined cases: null text counts as empty, with 0 bytes and 0 tokens; repeated rows are counted
each; texts of any length are read whole.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import fresh, map_batches, need

# Fixed value: the pre-token pattern of the byte-level tokenizers that this operator counts for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PROBE = "a{0}a {0}a1{0}1 {0}1!{0}! {0}!{0}{0} {0} {0}\n{0}'s{0}"


def prove(tokenizer: Tokenizer) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as one token."""
    cut = regex.compile(PATTERN)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ids = range(tokenizer.get_vocab_size(with_added_tokens=True))
    texts = [t for t in tokenizer.decode_batch([[i] for i in ids], skip_special_tokens=False) if t and "�" not in t]
    texts = [t for t in dict.fromkeys(texts) if t not in special and cut.findall(t) == [t]]
    sizes = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, sizes) if len(e.ids) == 1)


def plain(tokenizer_json: str) -> Tokenizer:
    """The tokenizer as the library's default reads it, without truncation or padding."""
    made = Tokenizer.from_str(tokenizer_json)
    made.no_truncation()
    made.no_padding()
    return made


class Merger:
    """Byte-pair merges of many strings at once.

    The strings lie end to end in one array. Each round merges, in every string, the pair with its lowest rank, at
    all its places from the left, as one-by-one merging would: a pair that holds the new symbol always ranks after
    the merge that made it.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, model: dict) -> None:
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[x] << 32) | vocab[y] for x, y in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[x + y] for x, y in pairs], dtype=np.int64)
        self.first = np.array([vocab[c] for c in byte_alphabet()], dtype=np.int64)

    def ranks(self, symbols: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.full(len(symbols), self.NONE, dtype=np.int32)
        if len(symbols) > 1 and len(self.keys):
            wanted = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            found = (self.keys[at] == wanted) & ~last[:-1]
            out[:-1][found] = self.rank[at[found]]
        return out

    def sizes(self, strings: list[str]) -> np.ndarray:
        raw = [s.encode() for s in strings]
        done = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        live = np.flatnonzero(done > 1)
        symbols = self.first[np.frombuffer(b"".join(raw), dtype=np.uint8)][np.repeat(done > 1, done)]
        sizes = done[live]
        while len(live):
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            last = np.zeros(len(symbols), dtype=bool)
            last[starts + sizes - 1] = True
            rank = self.ranks(symbols, last)
            least = np.minimum.reduceat(rank, starts)
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & (rank != self.NONE))
            begins = np.concatenate(([True], np.diff(at) != 1)) if len(at) else np.zeros(0, dtype=bool)
            run = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
            at = at[run % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            sizes = sizes - np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(live))
            open_ = (least != self.NONE) & (sizes > 1)
            done[live] = sizes
            symbols = symbols[keep][np.repeat(open_, sizes)]
            live, sizes = live[open_], sizes[open_]
        return done


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


def fits(spec: dict) -> bool:
    """True if ``Merger`` and ``PATTERN`` describe this tokenizer."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return (
        spec.get("normalizer") is None
        and pre.get("type") == "ByteLevel"
        and bool(pre.get("use_regex", True))
        and not pre.get("add_prefix_space", True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in odd)
        and all(c in model["vocab"] for c in byte_alphabet())
        and not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    )


def counter(tokenizer_json: str, whole: frozenset[str], max_cache: int = 100_000) -> Callable[[list], list[int]]:
    """A function from texts to their token counts; the cache of merged pre-tokens is emptied beyond ``max_cache``."""
    tokenizer, spec = plain(tokenizer_json), json.loads(tokenizer_json)
    if not fits(spec):
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    merger, cut = Merger(spec["model"]), regex.compile(PATTERN)
    special = [t["content"] for t in spec["added_tokens"]]
    at_special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
    trusted: set[str] = set()
    odd: set[str] = set()
    known: dict[str, int] = {}

    def judge(chars: set[str]) -> None:
        for c in chars - odd:
            text = PROBE.format(c)
            spans = [span for _, span in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
            (trusted if spans == [m.span() for m in cut.finditer(text)] else odd).add(c)

    def count(texts: list[str | None]) -> list[int]:
        total, rest, row, col, times = [0] * len(texts), {}, [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if new := set(text) - trusted:
                judge(new)
                if new & odd:
                    total[i] = len(tokenizer.encode(text, add_special_tokens=False).ids)
                    continue
            parts = at_special.split(text) if at_special and at_special.search(text) else [text]
            n = len(parts) - 1
            for part in parts:
                for token, k in Counter(cut.findall(part)).items():
                    if token in whole:
                        n += k
                    elif (had := known.get(token)) is not None:
                        n += k * had
                    else:
                        row.append(i)
                        col.append(rest.setdefault(token, len(rest)))
                        times.append(k)
            total[i] = n
        if rest:
            strings = list(rest)
            sizes = merger.sizes(strings)
            more = np.bincount(row, weights=sizes[col] * np.array(times), minlength=len(texts))
            total = [a + int(b) for a, b in zip(total, more)]
            if len(known) > max_cache:
                known.clear()
            known.update((s, int(n)) for s, n in zip(strings[:max_cache], sizes) if len(s) <= 64)
        return total

    return count


def count_tokens(
    docs: DataFrame, tokenizer_json: str, *, text: str = "text", keep: list[str] | None = None, name: str = "n_tokens"
) -> DataFrame:
    """``keep`` columns (default: all) and the token count as ``name`` (an underscore more if it clashes).

    ``tokenizer_json`` is the file's content; it and the proved strings, a few MB that depend on the vocabulary
    alone, are sent to every task.
    """
    need(docs, text)
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast((tokenizer_json, prove(plain(tokenizer_json))))

    def make() -> Callable:
        count = counter(*sent.value)
        return lambda batch: ([count(batch["text"].to_pylist())], None)

    return map_batches(docs, {"text": docs[f"`{text}`"]}, keep, [(fresh(name, keep), T.LongType())], make)


def digest(docs: DataFrame, tokenizer_json: str, limit: int = 1024) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    counted = count_tokens(docs.select("doc_id", "text", size.alias("n_bytes")), tokenizer_json, keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
