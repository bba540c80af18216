"""Personal data: candidate spans judged by gradient-boosted trees.

Base rules (email, ip, card, phone) give spans that always stay. Generators of high recall propose
further, overlapping spans: obfuscated addresses, numbers in national and grouped formats (every run
of neighbouring groups of digits), colon addresses, and strings of letters and digits that may be
secrets. Each candidate is described by its format and the 40 characters around it; boosted trees score
it, the score is calibrated on held-out rows, and a threshold per kind, chosen for a wanted precision,
selects. Of overlapping selected spans the more probable stays, and none may overlap a base span.

The trees are trained here on ``rows`` sentences made by a seeded generator, half with and half
without personal data, once per driver. A made card number has a right check digit; the same
formats with a wrong one are made as counterexamples, as are hashes and ids that look like secrets.

Defined cases: null text is empty and has no span; every text is read whole, in time linear in
its length; repeated rows are judged each by itself. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import bisect
import functools
import math
import random
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import BoostedTrees, margin, platt, sigmoid, threshold
from .common import fresh, map_batches, need

#: The kinds of the base rules, and the one that only the method finds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRACE = re.compile(r"[0-9@]")
HIDDEN = re.compile(r"[(\[{] ?(?:at|dot|AT|DOT) ?[)\]}]| dot | DOT ")

# Candidate generators; each match is bounded, so that a text costs time in proportion to its length.
HIDDEN_MAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]{1,64} ?(?:@|[(\[{] ?(?:at|AT) ?[)\]}]| (?:at|AT) ) ?"
    r"[\w-]{1,63}(?: ?(?:\.|[(\[{] ?(?:dot|DOT) ?[)\]}]| (?:dot|DOT) ) ?[\w-]{2,24}){1,4}"
)
DIGITS = re.compile(r"[0-9]+")
GAP = re.compile(r"[ ().\-/]+")
PREFIX = "(+"
SCORED = 10_000  # candidates described at once, at most
GAPS = 30  # characters between the groups of one number, at most
COLON = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![\w:])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,512}={0,2}(?![A-Za-z0-9+/_=-])")
BESIDE_LEFT = re.compile(r"([0-9]+)([ ().\-/,:]{1,5})$")
BESIDE_RIGHT = re.compile(r"([ ().\-/,:]{1,5})([0-9]+)")
# A local part of 64 characters and longer is found by the base rule alone.

CONTEXT = {
    "email": re.compile(r"mail|contact|write|address|courrier|correo", re.I),
    "ip": re.compile(r"\bip\b|host|server|login|address|from", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|pay|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|call|tel|mobile|fax|dial|contact|whatsapp|sms", re.I),
    "secret": re.compile(r"token|secret|passw|pwd|\bkey|api.?key|auth|bearer|credential", re.I),
}
PAIRED = re.compile(r"[=:]\s*[\"']?$")
AGAINST = re.compile(r"order|invoice|serial|\bid\b|isbn|version|ticket|sku|part|batch|ref|page|hash|log|build|timestamp|commit|sha|md5|digest|etag|uuid|#", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def in_range(address: str) -> bool:
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in address.split(".")))


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' matches."""
    found = []
    end, last = 0, -1
    at = text.find("@")
    while at >= 0:
        if at >= end:
            low = max(end, last + 1)
            part = text[low:at]
            start = low + len(part.rstrip(LOCAL))
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found.append((start, 0, m.end()))
                end = m.end()
        last = at
        at = text.find("@", at + 1)
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if in_range(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(only_digits(m.group())) <= 15]
    return sorted(found)


def numbers(text: str) -> list[tuple[int, int, int]]:
    """(start, end, digits) of every run of neighbouring groups that has 7 to 19 digits; runs overlap.

    A run begins after no letter and ends before none; brackets and a plus before its first group belong to it.
    A group of digits begins few runs, so the time is linear in the text.
    """
    groups = [m.span() for m in DIGITS.finditer(text)]
    joined = [bool(GAP.fullmatch(text, a[1], b[0])) and b[0] - a[1] <= GAPS for a, b in zip(groups, groups[1:])] + [False]
    word = lambda c: c == "_" or c.isalnum()
    found = []
    for i, (first, _) in enumerate(groups):
        start = first
        while start and first - start < 2 and text[start - 1] in PREFIX:
            start -= 1
        if first and word(text[first - 1]):
            continue
        if start and word(text[start - 1]):
            start = first
        n = gaps = 0
        for k in range(i, len(groups)):
            low, end = groups[k]
            n += end - low
            gaps += low - groups[k - 1][1] if k > i else 0
            if n > 19 or gaps > GAPS:
                break
            if n >= 7 and not (end < len(text) and word(text[end])):
                found.append((start, end, n))
            if not joined[k]:
                break
    return found


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all proposals; they may overlap each other and the base spans."""
    found = []
    if "@" in text or HIDDEN.search(text):
        found += [(m.start(), 0, m.end()) for m in HIDDEN_MAIL.finditer(text)]
    for start, end, n in numbers(text):
        if n <= 15:
            found.append((start, 3, end))
        if n >= 13:
            found.append((start, 2, end))
    if text.count(":") >= 3:
        found += [(m.start(), 1, m.end()) for m in COLON.finditer(text)]
    for m in SECRET.finditer(text):
        s = m.group()
        if any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s):
            found.append((m.start(), 4, m.end()))
    return found


def entropy(s: str) -> float:
    """Bits per character."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def kind_of_char(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?" else 5


def describe(text: str, span: tuple[int, int, int]) -> list[float]:
    start, kind, end = span
    s = text[start:end]
    d = only_digits(s)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g] or [0]
    marks = [c for c in s if not c.isalnum()]
    before, after = text[max(0, start - 40) : start], text[end : end + 20]
    gaps = {g for g in re.split(r"[0-9]+", s.lstrip(PREFIX)) if g}
    left, right = BESIDE_LEFT.search(before), BESIDE_RIGHT.match(after)
    return [
        kind == 0, kind == 1, kind == 2, kind == 3, kind == 4,
        len(s), len(d), len(d) / len(s), len(marks), len(set(marks)), s.count(" "), s.count("-"), s.count("."),
        s.count("/"), s.count(":"), s[0] == "+", "(" in s, "@" in s, bool(HIDDEN.search(s)),
        len(groups), min(groups), max(groups), groups[-1], groups[0], bool(d) and luhn(d), int(d[0]) if d else -1,
        len(set(d)), sum(a == b for a, b in zip(d, d[1:])), sum(c.isalpha() for c in s), max((len(x) for x in s.split(":")), default=0),
        kind_of_char(before[-1:]), kind_of_char(after[:1]),
        bool(CONTEXT[KINDS[kind]].search(before)), any(bool(r.search(before)) for r in CONTEXT.values()),
        bool(AGAINST.search(before)), bool(AGAINST.search(after)), any("0" <= c <= "9" for c in before[-12:] + after[:12]),
        groups[1] if len(groups) > 1 else 0, groups[-2] if len(groups) > 1 else 0, len(gaps),
        len(left[1]) if left else 0, len(right[2]) if right else 0, bool(left) and left[2] in gaps, bool(right) and right[1] in gaps,
        len(left[2]) if left else 0, len(right[1]) if right else 0, max((len(g) for g in gaps), default=0), s.count(" ") - s.count(") "),
        entropy(s) if kind == 4 else 0, sum(c in "0123456789abcdefABCDEF" for c in s) / len(s), any("A" <= c <= "Z" for c in s), any("a" <= c <= "z" for c in s),
        bool(PAIRED.search(before)),
    ]


def made_text(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A sentence and its marked spans (start, kind, end): none, one, or several where numbers are neighbours."""
    vowels, rest = "aeiouéüó", "bcdfghlmnprstvß"

    def word() -> str:
        return "".join(rng.choice(rest) + rng.choice(vowels) for _ in range(rng.randint(1, 4)))

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def valid_card(n: int) -> str:
        body = rng.choice("3456") + digits(n - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def card(right: bool = True) -> str:
        d = valid_card(rng.choice([13, 15, 16, 16, 16]))
        if not right:  # one digit off, so that the check digit is wrong
            at = rng.randrange(len(d))
            d = d[:at] + rng.choice([c for c in "0123456789" if c != d[at]]) + d[at + 1 :]
        gap = rng.choice(["", "", " ", "-", "."])
        return gap.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{a} {b}{c}", f"00{digits(2)} {a} {b}{c}", f"0{a}/{b}{c}", f"({a}){b}-{c}"])

    def value() -> str:
        if rng.random() < 0.5:
            return "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 40, 64])))
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        head = rng.choice(["", "", "sk-", "ghp_", "AKIA", "xoxb-"])
        return head + "".join(rng.choice(letters) for _ in range(rng.randint(16, 48))) + rng.choice(["", "", "="])

    def beside() -> list[tuple[str, int]]:
        """A phone or card number and what may stand beside it, in either order."""
        own = rng.choice([2, 3, 3])
        day, month, year = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1950, 2049)
        dates = [f"{year}-{month:02d}-{day:02d}", f"{day:02d}/{month:02d}/{year}", f"{day:02d}.{month:02d}.{year}", f"{year}"]
        if own == 2:
            other = rng.choice([(f"{month:02d}/{year % 100:02d}", -1), (f"{month:02d}/{year}", -1), (f"{month:02d}/{year % 100:02d} {digits(3)}", -1), (digits(3), -1), (card(), 2), (rng.choice(dates), -1)])
        else:
            other = rng.choice([(phone(), 3), (phone(), 3), (rng.choice(dates), -1), (digits(rng.randint(1, 5)), -1), (f"{digits(2)}:{digits(2)}", -1)])
        pair = [(card() if own == 2 else phone(), own), other]
        if own == 3 and other[1] == 3 and rng.random() < 0.3:
            pair.append((phone(), 3))
        rng.shuffle(pair)
        return pair

    kind = rng.choice([0, 1, 2, 3, 4, -1, -1, -1, -1, -2, -2, 9, 9])
    hint = ""
    if kind == 0:
        name, host, end = word(), word(), rng.choice(["com", "org", "net", "de", "fr", "es", "io"])
        at = rng.choice([" (at) ", "[at]", " [at] ", "(at)", " at ", " AT ", "@", " @ "])
        dot = rng.choice([" (dot) ", "[dot]", " [dot] ", "(dot)", " dot ", " DOT "]) if at.strip() != "@" or rng.random() < 0.7 else "."
        s = f"{name}{rng.choice(['', '.' + word(), str(rng.randint(1, 99))])}{at}{host}{dot}{end}"
        hint = rng.choice(["", "mail ", "contact ", "write to "])
    elif kind == 1:
        s = ":".join(f"{rng.randrange(65536):x}" for _ in range(8)) if rng.random() < 0.7 else f"2001:db8::{rng.randrange(65536):x}:{rng.randrange(65536):x}"
        hint = rng.choice(["", "host ", "ip ", "login from "])
    elif kind == 2:
        s = card()
        hint = rng.choice(["", "", "card ", "visa ", "pay with "])
    elif kind == 3:
        s = phone()
        hint = rng.choice(["", "", "phone ", "call ", "tel ", "mobile "])
    elif kind == 4:
        s = value()
        name = rng.choice(["token", "secret", "password", "api_key", "apikey", "key", "auth_token", "access_token", "credential", "pwd"])
        hint = f"{rng.choice([name, name.upper()])}{rng.choice([' = ', '=', ': ', ':'])}{rng.choice(['', chr(34), chr(39)])}" if rng.random() < 0.9 else "Bearer "
    elif kind == -2:  # what looks like a card or a secret
        if rng.random() < 0.5:
            s, hint = card(right=False), rng.choice(["", "", "", "card ", "visa ", "pay with "])
        else:
            s = value() if rng.random() < 0.6 else rng.choice([f"{value()[:8]}-{value()[:4]}-{value()[:4]}-{value()[:12]}", f"{word()}{word()}{word()}{digits(3)}", f"{word()}/{word()}/{word()}{digits(2)}"])
            hint = rng.choice(["commit ", "sha256:", "md5 ", "etag: ", "uuid=", "id = ", "hash ", "digest: ", "file ", "see ", ""])
    elif kind == 9:
        several = beside()
        hint = rng.choice(["", "", "phone ", "call ", "tel "] if any(k == 3 for _, k in several) else ["", "", "card ", "visa ", "pay with "])
    else:
        word_for = rng.choice(["order ", "invoice ", "serial ", "id ", "isbn ", "version ", "ticket ", "sku ", "ref ", "build ", "# ", "log ", ""])
        plain = [f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(2)}:{digits(2)}:{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(2)}.{digits(3)}.{digits(4)}", f"{rng.randint(1900, 2100)} - {rng.randint(1900, 2100)}", digits(7), digits(8), digits(10), f"{digits(3)} {digits(3)} {digits(3)} {digits(3)}", f"{word()} at {word()} dot.{word()}", f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(2)},{digits(3)},{digits(3)},{digits(3)}.{digits(2)}", " ".join(digits(rng.randint(1, 4)) for _ in range(rng.randint(3, 9)))]
        coded = [digits(rng.randint(7, 19)), f"{digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}", f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}"]
        s = rng.choice(plain + (coded * 3 if word_for else []))
        hint = word_for
    left = " ".join(word() for _ in range(rng.randint(0, 8)))
    left = f"{left}{rng.choice([' ', '. ', ', ', ': ']) if left else ''}{hint}"
    right = rng.choice(["", " ", ". ", ", ", " | "]) + " ".join(word() for _ in range(rng.randint(0, 6)))
    if right[:1].isalpha():
        right = " " + right
    if hint[-1:] in ("'", '"'):
        right = hint[-1] + right
    parts = several if kind == 9 else [(s, kind)]
    between = rng.choice([" ", " ", " / ", "/", " - ", ", ", ",", "; ", " or "])
    text, spans = left, []
    for i, (part, k) in enumerate(parts):
        text += between if i else ""
        if k >= 0:
            spans.append((len(text), k, len(text) + len(part)))
        text += part
    return text + right, spans


@functools.cache
def train(rows: int = 9000, seed: int = 20240501, precision: float = 0.97) -> dict:
    """Trees, calibration and a threshold per kind, from ``rows`` made sentences; a third is held out to calibrate."""
    rng = random.Random(seed)
    x, y, kinds = [], [], []
    for _ in range(rows):
        text, marked = made_text(rng)
        for span in candidates(text):
            x.append(describe(text, span))
            y.append(float(any(span[1] == kind and abs(span[0] - start) <= 1 and abs(span[2] - end) <= 1 for start, kind, end in marked)))
            kinds.append(span[1])
    x, y, kinds = np.array(x, dtype=float), np.array(y), np.array(kinds)
    held = np.arange(len(y)) % 3 == 0
    trees = BoostedTrees().fit(x[~held], y[~held]).arrays()
    raw = margin(trees, x[held])
    slope, offset = platt(raw, y[held])
    p = sigmoid(slope * raw + offset)
    cuts = [max(0.5, threshold(p[kinds[held] == k], y[held][kinds[held] == k], precision)) for k in range(len(KINDS))]
    chosen = p >= np.array(cuts)[kinds[held]]
    recall = float((chosen & (y[held] == 1)).sum() / max(1, (y[held] == 1).sum()))
    right = float((chosen & (y[held] == 1)).sum() / max(1, chosen.sum()))
    return {"trees": trees, "platt": (slope, offset), "cuts": cuts, "recall": recall, "precision": right}


def judge(model: dict, texts: list[str | None]) -> list[list[tuple[int, int, int, float]]]:
    """Per text its spans (start, kind, end, probability), base ones with probability 1, ordered by start and kind."""
    out: list[list[tuple[int, int, int, float]]] = []
    owner, spans, rows = [], [], []
    per_text: dict[int, list] = {}

    def score() -> None:
        raw = margin(model["trees"], np.array(rows, dtype=float))
        p = np.minimum(sigmoid(model["platt"][0] * raw + model["platt"][1]), 0.999999)  # 1 marks base spans
        good = p >= np.array(model["cuts"])[[s[1] for s in spans]]
        for k in np.flatnonzero(good):
            per_text.setdefault(owner[k], []).append((-p[k], spans[k]))
        for held in (owner, spans, rows):
            held.clear()

    for i, text in enumerate(texts):
        found = base_spans(text) if text and TRACE.search(text) else []
        out.append([(*s, 1.0) for s in found])
        if text and (TRACE.search(text) or HIDDEN.search(text)):
            own = set(found)
            for span in candidates(text):
                if span not in own:
                    owner.append(i)
                    spans.append(span)
                    rows.append(describe(text, span))
                    if len(rows) == SCORED:
                        score()
    if rows:
        score()
    for i, found in per_text.items():
        out[i] = without_overlap(out[i], sorted(found))
    return out


def without_overlap(base: list, found: list) -> list:
    """The base spans and, from the most probable on, each found one that overlaps no base span and none taken."""
    ordered = sorted(found, key=lambda f: f[1][0])
    edges = sorted((s, e) for s, _, e, _ in base)
    free, at = [], 0
    reach = 0  # furthest end of the base spans that start before the candidate's end
    for neg, (start, kind, end) in ordered:
        while at < len(edges) and edges[at][0] < start:
            reach = max(reach, edges[at][1])
            at += 1
        nexts = edges[at][0] if at < len(edges) else None
        if reach <= start and (nexts is None or nexts >= end):
            free.append((neg, (start, kind, end)))
    taken: list[tuple[int, int, int, float]] = []
    group: list = []
    limit = -1
    for item in [*free, None]:  # candidates are short, so a chain of overlapping ones is judged on its own
        if item is None or item[1][0] >= limit:
            own: list[tuple[int, int, int, float]] = []  # by place, without overlap
            for neg, (start, kind, end) in sorted(group):
                k = bisect.bisect(own, (start, 9))
                if (k == 0 or own[k - 1][2] <= start) and (k == len(own) or own[k][0] >= end):
                    own.insert(k, (start, kind, end, float(-neg)))
            taken += own
            group, limit = [], -1
        if item is not None:
            group.append(item)
            limit = max(limit, item[1][2])
    return sorted([*base, *taken])


SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
)


def rows_of(model: dict, texts: list[str | None]) -> list[list[dict]]:
    return [
        [{"kind": KINDS[k], "start": s, "end": e, "score": p, "base": p == 1.0} for s, k, e, p in found]
        for found in judge(model, texts)
    ]


def find_pii(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, model: dict | None = None) -> DataFrame:
    """``keep`` columns (default: all) and ``pii_spans``."""
    need(docs, text)
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model or train())

    def make() -> Callable:
        return lambda batch: ([rows_of(sent.value, batch["text"].to_pylist())], None)

    return map_batches(docs, {"text": docs[f"`{text}`"]}, keep, [(fresh("pii_spans", keep), SPANS)], make)


def redact(docs: DataFrame, *, text: str = "text", model: dict | None = None) -> DataFrame:
    """All columns, with each span of the text replaced by its kind in angle brackets; null stays null."""
    need(docs, text)
    sent = docs.sparkSession.sparkContext.broadcast(model or train())
    others = [c for c in docs.columns if c != text]

    def cover(value: str | None, found: list) -> str | None:
        if not found:
            return value
        parts, at = [], 0
        for start, kind, end, _ in found:
            if end > at:
                parts += [value[at : max(at, start)], f"<{KINDS[kind].upper()}>" if start >= at else ""]
                at = end
        return "".join([*parts, value[at:]])

    def make() -> Callable:
        def work(batch: dict) -> tuple[list, None]:
            texts = batch["text"].to_pylist()
            return [[cover(t, f) for t, f in zip(texts, judge(sent.value, texts))]], None

        return work

    done = map_batches(docs, {"text": docs[f"`{text}`"]}, others, [(text, T.StringType())], make)
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    found = find_pii(docs.select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("pii_spans", lambda s: s["base"])

    def joined(spans: F.Column) -> F.Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    def count(kind: str) -> F.Column:
        return F.size(F.filter("pii_spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("pii_spans")).alias("spans"),
        F.size(F.filter("pii_spans", lambda s: s["kind"] == "secret")).cast("long").alias("n_secret"),
    )
