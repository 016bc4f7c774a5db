"""Sharding into ranges of near-equal bytes, by sampled splitters.

Each record has a 64-bit key: high bits of a hash of its text, so that equal texts are neighbours, and low
bits of a hash of its id, so that any group of copies can be divided. Size-weighted samples of the keys give
quantile boundaries; overfull ranges are sampled again and subdivided. Within a range a window gives each
record its place, so running byte counts over all ranges are exact, and shards are cut from these.

Defined results: a null text has no bytes and the checksum of an empty one; equal texts are neighbours and
share a shard unless a boundary falls among them; repeated rows get slots of their own; ties of the whole
(key, id, size, checksum) are between equal rows, which share a task however many they are (rows without an id
count as equal if their texts are); an empty table gives an empty result; other columns of
the input do not matter.
"""

from __future__ import annotations

import bisect

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import cut, full_text, unit_hash

SHARDS = 24
#: Bytes that a record takes beside its text.
RECORD_BYTES = 8
#: Ranges for each shard, and key samples for each range: the driver holds SHARDS times their product.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 16, 24
#: A range of more than so many rows, or so many times the mean bytes, is subdivided.
RANGE_ROWS, OVERFULL = 2_000_000, 4
ROUNDS = 6
_LOW = (1 << 24) - 1


def sized(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(doc, id, size, text_crc32, key) of each document."""
    text = full_text()
    key = F.xxhash64(text).bitwiseAND(F.lit(~_LOW)).bitwiseOR(F.xxhash64(F.col("doc_id").cast("string"), F.lit(3)).bitwiseAND(F.lit(_LOW)))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"),
        F.col("doc_id").alias("id"),
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
    )


def lookup(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (index + 1).cast("int"))


def range_of(key: Column, splitters: list[int]) -> Column:
    """The number of splitters at or below the key, by binary search in a literal array."""
    if not splitters:
        return F.lit(0)
    table = F.array(*[F.lit(s).cast("long") for s in splitters])
    steps, step = [], 1 << (len(splitters).bit_length() - 1)
    while step:
        steps.append(F.lit(step))
        step >>= 1

    def probe(at: Column, by: Column) -> Column:
        end = at + by
        return F.when((end <= len(splitters)) & (F.get(table, end - 1) <= key), end).otherwise(at)

    return F.aggregate(F.array(*steps), F.lit(0), probe)


def _quantiles(samples: list[tuple[int, float]], parts: int) -> list[int]:
    samples, total = sorted(samples), sum(w for _, w in samples)
    out, run = [], 0.0
    for key, weight in samples:
        run += weight
        if run >= total * (len(out) + 1) / parts and len(out) < parts - 1:
            out.append(key)
    return out


def find_splitters(skeleton: DataFrame, shards: int = SHARDS) -> tuple[list[int], list[tuple[int, int, int]]]:
    """Boundaries, and (range, bytes, rows) of the ranges between them. ``skeleton``: (id, size, key)."""
    ranges = shards * RANGES_PER_SHARD
    total, rows = skeleton.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    splitters: list[int] = []
    wanted = {0: ranges}
    filled = [(0, total, rows)]
    for attempt in range(ROUNDS):
        if not rows:
            break
        place = range_of(F.col("key"), splitters)
        of = {r: (b, n) for r, b, n in filled}
        odds = [min(1e9, wanted[r] * SAMPLES_PER_RANGE / max(1, of[r][0])) if r in wanted and r in of else 0.0 for r in range(len(splitters) + 1)]
        chance = F.least(F.lit(1.0), F.element_at(F.array(*map(F.lit, odds)), place + 1) * F.col("size"))
        drawn = skeleton.select("key", "size", place.alias("range"), chance.alias("p")).where(unit_hash(F.col("key"), F.col("size"), seed=attempt) < F.col("p"))
        samples: dict[int, list[tuple[int, float]]] = {}
        for x in drawn.collect():  # a bounded number: SAMPLES_PER_RANGE for each range wanted
            samples.setdefault(x["range"], []).append((x["key"], x["size"] / x["p"]))
        found = {k for r, of_range in samples.items() for k in _quantiles(of_range, wanted[r])}
        if found <= set(splitters):
            break
        splitters = sorted(found | set(splitters))
        filled = [tuple(x) for x in skeleton.groupBy(range_of(F.col("key"), splitters).alias("range")).agg(F.sum("size"), F.count("*")).collect()]
        limit = max(1, OVERFULL * total // ranges)
        wanted = {r: 2 + max(int(2 * b // limit), int(2 * n // RANGE_ROWS)) for r, b, n in filled if n > 1 and (b > limit or n > RANGE_ROWS)}
        if not wanted:
            break
    return splitters, filled


def shard(docs: DataFrame, shards: int = SHARDS, keep: list[str] | None = None) -> DataFrame:
    """(doc struct of the columns in ``keep``, size, text_crc32, shard, slot).

    The window's shuffle moves what ``keep`` names; with whole texts that is the one move a physical
    sharding needs. Ranges are bounded, so no task holds a shard.
    """
    rows = sized(docs, keep)
    skeleton = cut(sized(docs, ["doc_id"]).select("id", "size", "text_crc32", "key"))
    splitters, filled = find_splitters(skeleton, shards)
    total = sum(b for _, b, _ in filled)
    of = {r: (b, n) for r, b, n in filled}
    before, first, run, count = [], [], 0, 0
    for r in range(len(splitters) + 1):
        before.append(run)
        first.append(count)
        run, count = run + of.get(r, (0, 0))[0], count + of.get(r, (0, 0))[1]

    def placed(of_rows: DataFrame) -> DataFrame:
        ordered = Window.partitionBy("range").orderBy("key", "id", "size", "text_crc32")
        of_rows = of_rows.withColumn("range", range_of(F.col("key"), splitters))
        of_rows = of_rows.withColumn("end", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(ordered))
        middle = lookup(before, F.col("range")) * 2 + F.col("end") * 2 - F.col("size")
        cut_at = F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * max(1, total))))
        return of_rows.withColumn("shard", cut_at.cast("int")).withColumn("nth", lookup(first, F.col("range")) + F.col("nth") - 1)

    starts = dict(tuple(x) for x in placed(skeleton).groupBy("shard").agg(F.min("nth")).collect())
    slot = F.col("nth") - lookup([starts.get(s, 0) for s in range(shards)], F.col("shard"))
    return placed(rows).select("doc", "size", "text_crc32", "shard", slot.alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, rows_per_file: int = 1_000_000) -> None:
    """Write whole documents as shard=N folders with a column slot, in slot order within each file's rows.

    Where the documents have columns of these names, ours have as many underscores before them as it takes.
    """
    names = {c.lower() for c in docs.columns}
    by, place = "shard", "slot"
    while by in names:
        by = f"_{by}"
    while place in names:
        place = f"_{place}"
    placed = shard(docs, shards).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns], F.col("shard").alias(by), F.col("slot").alias(place))
    placed.repartitionByRange(by, place).sortWithinPartitions(by, place).write.option("maxRecordsPerFile", rows_per_file).partitionBy(by).parquet(path)


def shard_of(value: int, splitters: list[int]) -> int:
    """``range_of`` for one key, in Python."""
    return bisect.bisect_right(splitters, value)
