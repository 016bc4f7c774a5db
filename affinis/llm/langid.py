"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams per language come from executors as sparse rows; the matrix of log probabilities
(languages x buckets) is broadcast, and batches of texts are scored in numpy.

Defined results: a null text, an empty one and one without a letter are ``und`` with score 0; ties go to
the language that sorts first; without a learned language everything is ``und``; long texts are scored in
pieces, so memory does not depend on their length; repeated rows are scored alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.common import held_out, ready_workers, unit_hash

UNKNOWN = "und"
#: Buckets of the hashed n-grams (a power of two) and their lengths.
BITS, LENGTHS = 15, (1, 2, 3)
#: The model is fitted on about so many labelled documents at most, drawn by a hash of their ids.
MAX_TRAIN_DOCS = 8000
SMOOTHING = 0.5
#: n-grams depend on each other: evidence counts as that of so many at most.
EVIDENCE = 60
#: Characters that are scored at once.
PIECE = 1 << 19


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Per n-gram length, the bucket of the n-gram that begins at each place; -1 where it would be spaces alone."""
    n, out, h, some = len(codes), [], np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    padded = np.concatenate([codes, np.full(max(LENGTHS), 32, np.uint32)])
    for k in range(max(LENGTHS)):
        c = padded[k : k + n]
        some = some | (c != 32)
        h = (h + c + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        if k + 1 in LENGTHS:
            mixed = (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)
            out.append(np.where(some, mixed.astype(np.int32), np.int32(-1)))
    return out


def _pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, number of starts of each part, document of each part) of about PIECE characters."""
    gap = np.full(2, 32, np.uint32)
    codes: list[np.ndarray] = []
    sizes: list[int] = []
    owner: list[int] = []
    held = 0
    for i, text in enumerate(texts):
        if not text:
            continue
        for at in range(0, len(text), PIECE):
            part = _codes(text[at : at + PIECE + 2])
            n = min(PIECE, len(text) - at)
            # the two places after each part are no starts of their own: they hold the next part's first letters, or spaces
            part = np.concatenate([part, gap[: n + 2 - len(part)]])
            codes.append(part)
            sizes.append(n)
            owner.append(i)
            held += n
            if held >= PIECE:
                yield np.concatenate(codes), np.array(sizes), np.array(owner)
                codes, sizes, owner, held = [], [], [], 0
    if codes:
        yield np.concatenate(codes), np.array(sizes), np.array(owner)


def _grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(first place of each part, document of each part, buckets by length)."""
    for codes, sizes, owner in _pieces(texts):
        begin = np.concatenate([[0], np.cumsum(sizes + 2)[:-1]])
        found = buckets(codes)
        for b in found:  # the gaps between parts
            ends = begin + sizes
            b[ends] = -1
            b[ends + 1] = -1
        yield begin, owner, found


def train(docs: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probabilities by language and bucket, log priors) from text, lang and doc_id."""
    ready_workers(docs.sparkSession)
    usable = docs.where(~held_out() & F.col("lang").isNotNull())
    n = usable.count()
    chosen = usable.where(unit_hash(F.col("doc_id"), seed=8) < min(1.0, max_docs / max(1, n))).select("lang", "text").where(F.col("text").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for lang in langs:
                seen[lang] = seen.get(lang, 0) + 1
            for begin, owner, found in _grams(texts):
                names = sorted({langs[o] for o in owner})
                code = {x: i for i, x in enumerate(names)}
                which = np.array([code[langs[o]] for o in owner])
                edges = np.zeros(len(found[0]), np.int64)
                edges[begin[1:]] = 1
                part = which[np.cumsum(edges)]
                for b in found:
                    keep = b >= 0
                    got = np.bincount(part[keep] * (1 << BITS) + b[keep], minlength=len(names) << BITS).reshape(len(names), -1)
                    for i, x in enumerate(names):
                        sums[x] = sums.get(x, 0) + got[i]
        for lang, docs_seen in seen.items():
            row = sums.get(lang, np.zeros(1 << BITS, np.int64))
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": np.append(at, -1).astype(np.int32), "n": np.append(row[at], docs_seen).astype(np.int64)})

    rows = chosen.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(rows["lang"].unique())
    table, prior = np.zeros((len(langs), 1 << BITS)), np.zeros(len(langs))
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        b, c = own["bucket"].to_numpy(), own["n"].to_numpy()
        prior[i] = c[b < 0].sum()
        table[i, b[b >= 0]] = c[b >= 0]
    table = np.log((table + SMOOTHING) / (table + SMOOTHING).sum(1, keepdims=True)) if langs else table
    return langs, table.astype(np.float32), np.log(prior / prior.sum()) if langs else prior


def score(texts: list[str | None], langs: list[str], table: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The language of each text and the share of the tempered posterior that it has."""
    total, grams, letters = np.zeros((len(texts), len(langs))), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for begin, owner, found in _grams(texts):
        letters += np.bincount(owner, np.add.reduceat(found[0] >= 0, begin, dtype=np.int64), len(texts)).astype(np.int64)
        for b in found:
            some = b >= 0
            grams += np.bincount(owner, np.add.reduceat(some, begin, dtype=np.int64), len(texts))
            for j in range(len(langs)):
                got = np.where(some, table[j][b], np.float32(0))
                total[:, j] += np.bincount(owner, np.add.reduceat(got, begin, dtype=np.float64), len(texts))
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    tempered = total / np.maximum(grams, 1)[:, None] * np.minimum(grams, EVIDENCE)[:, None] + prior
    best = np.argmax(tempered, 1)
    odds = np.exp(tempered - tempered.max(1, keepdims=True))
    share = (odds / odds.sum(1, keepdims=True))[np.arange(len(texts)), best] if len(texts) else np.zeros(0)
    return [langs[k] if n else UNKNOWN for k, n in zip(best, letters)], np.where(letters > 0, share, 0.0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """(doc struct of the columns in ``keep``, lang_pred, score)."""
    spark = docs.sparkSession
    ready_workers(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, share = score(batch.column("text").to_pylist(), *shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(names, pa.string()), pa.array(share, pa.float64())], ["doc", "lang_pred", "score"])

    out = T.StructType([rows.schema["doc"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, out)


def identify(docs: DataFrame, keep: list[str] | None = None, max_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """Learn from the documents that are not held out, and predict all."""
    return predict(docs, train(docs, max_docs), keep)
