"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from fixed patterns. The field labels the tokens that hold a digit or an ``@``: neighbours in
the text share a potential, and so does each token with the last one before it that is the same or has the
same shape, however far back. Loopy belief propagation gives each token's label; tokens in base spans keep
theirs, and other tokens with a label add spans.

The field is fitted piecewise from counts over all documents: a softmax of token features on the labels that
the base spans give, and pair potentials from how much more often than by chance two labels meet at neighbours, at
repeated tokens and at tokens of one shape.

Defined results: a null text is an empty one and has no spans; positions count code points; spans that the
field adds never overlap base spans; repeated rows have equal spans; the work on a very long text is in
proportion to its tokens, as each is tied to one earlier token per kind of tie; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.common import ready_workers

KINDS = ("email", "ip", "card", "phone")
#: Label 0 is none; KINDS follow.
LABELS = len(KINDS) + 1
#: Of an email address, what may stand before the @ (looked for backwards from there) and what must follow it.
MAILBOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Numbers joined by single dots, of which each four in order are an ip.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SEEN = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: Rounds of message passing at most, the weight of old messages, and the least belief that adds a span.
ROUNDS, DAMPING, BELIEF = 30, 0.3, 0.6
STEPS, RATE, DECAY = 800, 1.0, 1e-4
#: Pair potentials are fitted as if so many pairs of independent labels had been seen too, and are no stronger than PULL.
PRIOR, PULL = 20.0, 4.0
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if place % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end), by kind and start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in MAILBOX:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if not re.search("[0-9]", text):
        return out
    for m in DOTTED.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, start = m.group().split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in four):
                out.append((1, start, end))
            start = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


_ALNUM = frozenset("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_FIRST, _LAST = _ALNUM | set("+(@"), _ALNUM | set(")@")
_SHAPES = [
    re.compile(x + r"\Z")
    for x in (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z0-9-]+",
        r"\d{1,3}(?:\.\d{1,3}){3}",
        r"\d+(?:\.\d+)*",
        r"\d{16,19}",
        r"\d{4}",
        r"\+\d{1,3}",
        r"\(\d{2,4}\)",
        r"\d{2,4}-\d{3,5}",
        r"\d{1,2}",
        r"\d{3}",
        r"\d{5,15}",
        r"[0-9a-fA-F]{12,}",
        r"\+[0-9().-]{7,}",
    )
]
FEATURES = len(_SHAPES) + 9


class Tokens:
    """The tokens of a text that hold a digit or an @, without outer punctuation."""

    def __init__(self, text: str) -> None:
        self.start: list[int] = []
        self.end: list[int] = []
        self.core: list[str] = []
        self.next_to: list[bool] = []
        last = -2
        at = 0
        while (hit := SEEN.search(text, at)) is not None:
            p = hit.start()
            start = p
            while start > 0 and text[start - 1] not in " \t\n\v\f\r":
                start -= 1
            end = TOKEN.match(text, p).end()
            first, behind = start, end
            while first < behind and text[first] not in _FIRST:
                first += 1
            while behind > first and text[behind - 1] not in _LAST:
                behind -= 1
            between = text[last:start] if last >= 0 else "x"
            self.next_to.append(last >= 0 and len(between) < 8 and not between.strip())
            self.start.append(first)
            self.end.append(behind)
            self.core.append(text[first:behind])
            last = at = end

    def features(self) -> np.ndarray:
        out = np.zeros((len(self.core), FEATURES), np.float64)
        for i, x in enumerate(self.core):
            row = out[i]
            for k, shape in enumerate(_SHAPES):
                if shape.match(x):
                    row[k] = 1
            digits = sum(c.isdigit() for c in x)
            k = len(_SHAPES)
            row[k] = 16 <= digits <= 19 and digits == len(x) and luhn(x) if x.isascii() else 0
            row[k + 1] = "@" in x
            row[k + 2] = digits == len(x)
            row[k + 3] = any(c.isalpha() for c in x)
            row[k + 4] = "=" in x or '"' in x
            row[k + 5] = i > 0 and self.next_to[i] and self.core[i - 1][:1] == "+"
            row[k + 6] = i > 0 and self.next_to[i] and self.core[i - 1][:1] == "("
            row[k + 7] = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in x.split(".")) if out[i, 1] else 0
            row[k + 8] = 1
        return out

    def ties(self) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Each token with the last one before it that is the same, or else has the same shape."""
        same: list[tuple[int, int]] = []
        like: list[tuple[int, int]] = []
        by_text: dict[str, int] = {}
        by_shape: dict[str, int] = {}
        for i, x in enumerate(self.core):
            low = x.lower()
            shape = re.sub("[a-z]+", "a", re.sub("[0-9]", "9", low))
            if low in by_text:
                same.append((by_text[low], i))
            elif shape in by_shape:
                like.append((by_shape[shape], i))
            by_text[low] = by_shape[shape] = i
        return same, like


def known_labels(tokens: Tokens, spans: list[Span]) -> np.ndarray:
    """The label that base spans give each token; 0 if none overlaps it."""
    label = np.zeros(len(tokens.core), np.int64)
    start, end = np.array(tokens.start, np.int64), np.array(tokens.end, np.int64)
    for kind, a, b in sorted(spans, key=lambda s: -s[0]):
        first, last = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
        label[first:last] = kind + 1
    return label


class Field:
    """Weights of token features by label, and potentials (label by label) of neighbours, equal tokens and tokens of one shape."""

    def __init__(self, weights: np.ndarray, step: np.ndarray, same: np.ndarray, like: np.ndarray) -> None:
        self.weights, self.step, self.same, self.like = weights, step, same, like

    def beliefs(self, tokens: Tokens, known: np.ndarray) -> np.ndarray:
        """Marginals of each token's label by loopy belief propagation; known labels are held."""
        n = len(tokens.core)
        unary = tokens.features() @ self.weights
        unary -= unary.max(1, keepdims=True)
        local = np.exp(unary)
        local[known > 0] = np.eye(LABELS)[known[known > 0]]
        chain = [(i - 1, i) for i in range(1, n) if tokens.next_to[i]]
        same, like = tokens.ties()
        edges = np.array(chain + same + like, np.int64).reshape(-1, 2)
        if not len(edges):
            return local / local.sum(1, keepdims=True)
        kinds = np.repeat([0, 1, 2], [len(chain), len(same), len(like)])
        forward = np.exp(np.stack([self.step, self.same, self.like]))[kinds]
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        potential = np.concatenate([forward, forward.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        log_local = np.log(local + 1e-12)
        message = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            total = log_local.copy()
            np.add.at(total, target, message)
            out = total[source] - message[back]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.log(np.einsum("es,est->et", out, potential) + 1e-12)
            new -= new.max(1, keepdims=True)
            change = abs(new - message).max()
            message = DAMPING * message + (1 - DAMPING) * new
            if change < 1e-3:
                break
        total = log_local.copy()
        np.add.at(total, target, message)
        total = np.exp(total - total.max(1, keepdims=True))
        return total / total.sum(1, keepdims=True)


def find_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, spans that the field adds)."""
    base = base_spans(text)
    if not SEEN.search(text):
        return base, []
    tokens = Tokens(text)
    known = known_labels(tokens, base)
    if known.all():
        return base, []
    belief = field.beliefs(tokens, known)
    label = np.where(belief.max(1) >= BELIEF, belief.argmax(1), 0)
    added: list[Span] = []
    for i in np.flatnonzero((label > 0) & (known == 0)):
        kind = int(label[i]) - 1
        goes_on = KINDS[kind] == "phone" and added and added[-1][0] == kind and tokens.next_to[i] and added[-1][2] == tokens.end[i - 1] and tokens.core[i][:1] != "+"
        if goes_on:
            added[-1] = (kind, added[-1][1], tokens.end[i])
        elif tokens.end[i] > tokens.start[i]:
            added.append((kind, tokens.start[i], tokens.end[i]))
    return base, added


def count(texts: list[str | None], out: Counter) -> None:
    """What the field is fitted from: ("u", features, label), ("t", label, label of the next), ("s" or "m", label, label)."""
    for text in texts:
        if not text or not SEEN.search(text):
            continue
        tokens = Tokens(text)
        label = known_labels(tokens, base_spans(text)).tolist()
        for row, y in zip((tokens.features() > 0).astype(int).tolist(), label):
            out["u", "".join(map(str, row)), y] += 1
        for i in range(1, len(label)):
            if tokens.next_to[i]:
                out["t", str(label[i - 1]), label[i]] += 1
        for name, ties in zip("sm", tokens.ties()):
            for i, j in ties:
                out[name, str(label[i]), label[j]] += 1


def fit(rows: list[tuple[str, str, int, int]]) -> Field:
    """From (what, features or label, label, count) rows, a few hundred: features are a fixed set of flags."""
    unary = [(x, y, n) for what, x, y, n in rows if what == "u"]
    weights = np.zeros((FEATURES, LABELS))
    if unary:
        x = np.array([[int(c) for c in bits] for bits, _, _ in unary], float)
        n = np.array([n for _, _, n in unary], float)
        target = np.eye(LABELS)[[y for _, y, _ in unary]]
        share = (n / n.sum())[:, None]
        momentum = np.zeros_like(weights)
        for _ in range(STEPS):
            z = x @ weights
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            momentum = 0.9 * momentum + x.T @ (share * (target - p)) - DECAY * weights
            weights = weights + RATE * momentum
    seen = {what: np.zeros((LABELS, LABELS)) for what in "tsm"}
    share = np.full(LABELS, 0.5)
    for what, x, y, n in rows:
        if what in seen:
            seen[what][int(x), y] += n
        else:
            share[y] += n
    return Field(weights, *(affinity(seen[what], share / share.sum()) for what in "tsm"))


def affinity(seen: np.ndarray, share: np.ndarray) -> np.ndarray:
    """How much likelier a label is beside another than by itself, as a logarithm (the mean of both directions); near 0 where little was seen.

    ``share``: of each label among all tokens.
    """
    joint = (seen + PRIOR * np.outer(share, share)) / (seen.sum() + PRIOR)
    alone = np.outer(np.sqrt(joint.sum(1) * share), np.sqrt(joint.sum(0) * share))
    return np.clip(np.log(joint / alone), -PULL, PULL)


def train(docs: DataFrame) -> Field:
    """Counted over all documents; what reaches the driver is bounded by the number of flag combinations."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            count(batch.column("text").to_pylist(), sums)
        yield pa.RecordBatch.from_pydict({"what": [k[0] for k in sums], "x": [k[1] for k in sums], "y": [k[2] for k in sums], "n": list(sums.values())}, schema=pa.schema([("what", pa.string()), ("x", pa.string()), ("y", pa.int32()), ("n", pa.int64())]))

    counted = docs.select("text").mapInArrow(run, "what string, x string, y int, n long").groupBy("what", "x", "y").agg(F.sum("n").alias("n"))
    return fit(sorted(tuple(r) for r in counted.collect()))


def detect(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """(doc struct of the columns in ``keep``, base array and added array of (kind, start, end))."""
    spark = docs.sparkSession
    ready_workers(spark)
    shared = spark.sparkContext.broadcast(field)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"), F.col("text").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [find_spans(t or "", shared.value) for t in batch.column("text").to_pylist()]
            columns = [pa.array([[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(x[side])] for x in both], kind) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *columns], ["doc", "base", "added"])

    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("base", span), T.StructField("added", span)]))


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return detect(docs, train(docs), keep)

