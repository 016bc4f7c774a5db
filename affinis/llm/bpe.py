"""Byte-level BPE, encoding and decoding.

The pieces of a batch that are not in a cache are laid out in one linked list of byte tokens. Each merge
rank has a bucket of the places where its pair begins; a three-level bitmap over the ranks finds the
lowest one that is not empty; entries whose pair has changed since are stale and skipped. The cost is in
proportion to the bytes and merges, also for a single very long piece.

Defined results: a null text is encoded as an empty one: no ids, the digest of nothing; repeated rows are
encoded alike; an empty table gives an empty result; ids that are out of the vocabulary raise an error when
decoded. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from affinis.llm.common import ready_workers

#: Pieces in each of the two generations of a worker's cache (some 200 MB each when full); longer pieces are never kept.
CACHE_PIECES, CACHE_CHARS = 800_000, 40
#: Characters whose new pieces are merged together: enough to share the set-up, few enough for the CPU's caches.
GROUP_CHARS = 250_000

#: In the linked list, what stands between words and where a token was merged into its left neighbour.
END, DEAD = (1 << 20) - 2, (1 << 20) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class RankBits:
    """A set of ranks with find-first-set: 64-way words on three levels."""

    def __init__(self, n: int) -> None:
        self.low = [0] * ((n >> 6) + 1)
        self.mid = [0] * ((n >> 12) + 1)
        self.top = 0

    def add(self, rank: int) -> None:
        i, j = rank >> 6, rank >> 12
        self.low[i] |= 1 << (rank & 63)
        self.mid[j] |= 1 << (i & 63)
        self.top |= 1 << j

    def pop_first(self) -> int:
        """Remove and return the lowest rank; -1 if there is none."""
        top = self.top
        if not top:
            return -1
        j = (top & -top).bit_length() - 1
        mid = self.mid[j]
        i = (j << 6) | ((mid & -mid).bit_length() - 1)
        low = self.low[i]
        rank = (i << 6) | ((low & -low).bit_length() - 1)
        low &= low - 1
        self.low[i] = low
        if not low:
            mid &= mid - 1
            self.mid[j] = mid
            if not mid:
                self.top = top & (top - 1)
        return rank


class Tokenizer:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.pieces = regex.compile(pattern).findall
        self.size = max(ranks.values(), default=-1) + 1
        self.bytes_of: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(self.size)]
        self.byte_ids = [ranks.get(bytes([b]), -1) for b in range(256)]
        #: (left id << 20 | right id) -> id of both together, for every split of a token into two tokens.
        self.pairs = {
            (ranks[token[:k]] << 20) | ranks[token[k:]]: rank
            for token, rank in ranks.items()
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        }
        #: The rank of each two bytes, by 256 times the first plus the second.
        self.byte_pairs = [ranks.get(bytes([a, b])) for a in range(256) for b in range(256)]
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def merge(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word by merges alone. END stands after each word; no pair with it is in the table."""
        get, byte_ids, byte_pairs = self.pairs.get, self.byte_ids, self.byte_pairs
        ids: list[int] = [END]
        rank_at: list[int | None] = [None]
        for word in words:
            ids += [byte_ids[b] for b in word]
            ids.append(END)
            rank_at += [byte_pairs[(a << 8) | b] for a, b in zip(word, word[1:])]
            rank_at += (None, None) if word else (None,)
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        bits = RankBits(self.size)
        add = bits.add
        buckets: dict[int, list[int]] = {}
        for i, r in enumerate(rank_at):
            if r is not None:
                if r in buckets:
                    buckets[r].append(i)
                else:
                    buckets[r] = [i]
                    add(r)
        while (rank := bits.pop_first()) >= 0:
            places = buckets.pop(rank)
            if len(places) > 1:
                places.sort()
            high = rank << 20
            for k, i in enumerate(places):
                if rank_at[i] != rank:
                    continue  # stale
                j = after[i]
                right, left = after[j], before[i]
                ids[i], ids[j], rank_at[j], after[i], before[right] = rank, DEAD, None, right, i
                up = rank_at[i] = get(high | ids[right])
                down = rank_at[left] = get((ids[left] << 20) | rank)
                wait = False
                if up is not None:
                    if up in buckets:
                        buckets[up].append(i)
                    else:
                        buckets[up] = [i]
                        add(up)
                    wait = up <= rank
                if down is not None:
                    if down in buckets:
                        buckets[down].append(left)
                    else:
                        buckets[down] = [left]
                        add(down)
                    wait = wait or down <= rank
                if wait and k + 1 < len(places):  # the others wait until the lower rank is done
                    if rank in buckets:
                        buckets[rank] += places[k + 1 :]
                    else:
                        buckets[rank] = places[k + 1 :]
                        add(rank)
                    break
        out, own = [], []
        for x in islice(ids, 1, None):
            if x < END:
                own.append(x)
            elif x == END:
                out.append(tuple(own))
                own = []
        return out

    def _learn(self, pieces: Iterable[str]) -> None:
        """Put the ids of these pieces in the cache."""
        words: list[str] = []
        for piece in pieces:
            if (known := self.old.get(piece)) is not None:
                self.young[piece] = known
            elif (whole := self.ranks.get(piece.encode())) is not None:
                self.young[piece] = (whole,)
            else:
                words.append(piece)
        for piece, ids in zip(words, self.merge([w.encode() for w in words])):
            self.young[piece] = ids

    def encode_batch(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text. Texts are taken together until they have some GROUP_CHARS characters."""
        group: list[list[str]] = []
        held = 0
        for text in texts:
            group.append(self.pieces(text) if text else [])
            held += len(text or "")
            if held > GROUP_CHARS:
                yield from self._encode(group)
                group, held = [], 0
        yield from self._encode(group)

    def _encode(self, group: list[list[str]]) -> Iterator[list[int]]:
        if len(self.young) > CACHE_PIECES:
            self.old, self.young = self.young, {}
        new = set().union(*group).difference(self.young)
        gc.disable()  # nothing here has cycles, and a collection would visit the whole cache
        self._learn(new)
        gc.enable()
        get = self.young.__getitem__
        for pieces in group:
            yield list(chain.from_iterable(map(get, pieces)))
        for piece in new:
            if len(piece) > CACHE_CHARS:
                del self.young[piece]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


#: A worker's last tokenizer, by the key of its ranks.
_SHARED: dict[str, Tokenizer] = {}


def shared_tokenizer(spark: SparkSession, path: str, pattern: str):
    """A function for workers that returns their tokenizer. The ranks (about 1 MB) are read by the driver and broadcast."""
    loaded = load_ranks(path)
    key = hashlib.sha256(repr((sorted(loaded.items()), pattern)).encode()).hexdigest()
    ranks = spark.sparkContext.broadcast((loaded, pattern))

    def own() -> Tokenizer:
        if key not in _SHARED:
            _SHARED.clear()
            _SHARED[key] = Tokenizer(*ranks.value)
        return _SHARED[key]

    return own


def encode(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """(doc struct of the columns in ``keep``, ids array<int>)."""
    ready_workers(docs.sparkSession)
    own = shared_tokenizer(docs.sparkSession, path, pattern)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = own()
        for batch in batches:
            ids = pa.array(tokenizer.encode_batch(batch.column("text").to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), ids], ["doc", "ids"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc, decoded binary) of (doc, ids); null ids are none."""
    own = shared_tokenizer(encoded.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = own()
        for batch in batches:
            data = pa.array([tokenizer.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), data], ["doc", "decoded"])

    rows = encoded.select("doc", "ids")
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, with_ids: bool = False) -> DataFrame:
    """(doc, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids): encode and decode in one pass.

    Digests stand for the decoded bytes, and for the ids unless they are asked for.
    """
    ready_workers(docs.sparkSession)
    own = shared_tokenizer(docs.sparkSession, path, pattern)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"), F.col("text").alias("text"))
    names = ["doc", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids"] if with_ids else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = own()
        for batch in batches:
            counts, of_ids, of_bytes, kept = [], [], [], []
            for ids in tokenizer.encode_batch(batch.column("text").to_pylist()):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(tokenizer.text_of.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(tokenizer.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(array("i", ids))
            out = [batch.column("doc"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            if with_ids:
                flat = pa.array(np.concatenate([np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in kept] or [np.zeros(0, np.int32)]))
                out.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat))
            yield pa.RecordBatch.from_arrays(out, names)

    kinds = [T.LongType(), T.StringType(), T.StringType(), T.ArrayType(T.IntegerType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *[T.StructField(c, k) for c, k in zip(names[1:], kinds)]]))
