"""Document fingerprints by SimHash, on DataFrame functions alone.

A term is a word with the word after it, weighted by the length of both. Its hash votes with its weight for
or against each of 64 bits. Votes are summed by partial aggregation: three counters of 21 bits share a long,
so that a term costs 23 additions, and parts of at most CHUNK terms are unpacked before they are added up.
All fingerprints within a Hamming radius are found by tables of permuted blocks: of RADIUS + SPARE blocks some
SPARE must be equal, for every choice of which. ``compare_with_next`` looks up each edited text's fingerprint in the
tables of all documents' fingerprints.

Defined results: a null text is an empty one, without terms and with the fingerprint zero; equal texts have
equal fingerprints; documents follow each other by descending id, null ids last, rows of one id by a hash of
their text; the last is followed by the first, and a single one by itself; texts of any length are added up in
parts; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from affinis.llm.common import cut_table, full_text
from affinis.llm.sharding import lookup, range_of

SPACE = r"[\x20\x09-\x0D]+"
BITS, LANE, CHUNK = 64, 21, 1 << 16
#: The largest weight of a term; CHUNK times it stays below 2 ** LANE.
HEAVY = 31
#: Documents in a bucket of neighbours, and buckets at most.
BUCKET_ROWS, BUCKETS = 5000, 16_384
RADIUS, SPARE = 3, 3
_LANES = 1 | 1 << LANE | 1 << 2 * LANE
_FIRST_ID = -(1 << 63)


def _terms(text: Column) -> Column:
    """For each word, 59 bits of a hash of it and the next one, and in the low 5 bits their weight."""
    words = F.split(text, SPACE)

    def term(word: Column, after: Column) -> Column:
        weight = F.least(F.lit(HEAVY), F.length(word) + F.coalesce(F.length(after), F.lit(0))).cast("long")
        return F.shiftleft(F.xxhash64(word, after), 5).bitwiseOR(weight)

    return F.zip_with(words, F.slice(words, F.lit(2), F.size(words)), term)


def vote(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, fp long) of the rows (keys, text); texts with equal keys are taken together."""
    terms = texts.select(*keys, F.posexplode(_terms(F.col(text))).alias("at", "term"))
    weight = F.col("term").bitwiseAND(F.lit(HEAVY))
    bits = F.xxhash64(F.shiftrightunsigned("term", 5))
    terms = terms.select(*keys, F.shiftright("at", 16).alias("chunk"), weight.alias("w"), bits.alias("h"))
    packed = [F.sum(F.shiftrightunsigned("h", j).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"s{j}") for j in range(LANE)]
    last = F.sum(F.shiftrightunsigned("h", 63) * F.col("w")).alias("s63")
    parts = terms.groupBy(*keys, "chunk").agg(*packed, last, F.sum("w").alias("w"))
    votes = [F.sum(F.shiftrightunsigned(f"s{i % LANE}", LANE * (i // LANE)).bitwiseAND(F.lit((1 << LANE) - 1))).alias(f"v{i}") for i in range(BITS - 1)]
    summed = parts.groupBy(*keys).agg(*votes, F.sum("s63").alias("v63"), F.sum("w").alias("w"))
    fp = F.lit(0).cast("long")
    for i in range(BITS):
        value = (1 << i) - (1 << 64 if i == 63 else 0)
        fp = fp.bitwiseOR(F.when(F.col(f"v{i}") * 2 > F.col("w"), F.lit(value)).otherwise(F.lit(0)))
    return summed.select(*keys, fp.alias("fp"))


def written(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def in_order(docs: DataFrame) -> DataFrame:
    """(bucket, nth, visitor, doc_id, text, next) of the documents by descending id, cut into ranges.

    Ranges of ids come from quantiles. The first document of a range also visits the range before it, after
    all that are there, so each document sees the next one within its own range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST_ID)).alias("place"), full_text().alias("text"))
    ids = rows.select("place")
    n = ids.count()
    buckets = min(BUCKETS, max(1, -(-n // BUCKET_ROWS)))
    splitters: list[int] = []
    if buckets > 1:
        cuts = F.percentile_approx("place", F.array(*[F.lit(k / buckets) for k in range(1, buckets)]), F.lit(max(10_000, 20 * buckets)))
        splitters = sorted(set(ids.agg(cuts.alias("x")).first()["x"]))
    of = range_of(F.col("place"), splitters).cast("int")
    first = {b: top for b, top in ids.groupBy(of.alias("b")).agg(F.max("place")).collect()}  # a row for each range
    filled = sorted(first)
    tops = [first.get(b, _FIRST_ID) for b in range(len(splitters) + 1)]
    # ids fall, so the range before this one is the next higher; before the highest comes the lowest
    before = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}
    hosts = [before.get(b, 0) for b in range(len(splitters) + 1)]
    dealt = rows.withColumn("home", of)
    visits = F.array(F.struct(F.col("home").alias("bucket"), F.lit(False).alias("visitor")), F.struct(lookup(hosts, F.col("home")).cast("int").alias("bucket"), F.lit(True).alias("visitor")))
    alone = F.slice(visits, 1, 1)
    dealt = dealt.select("doc_id", "place", "text", F.explode(F.when(F.col("place") == lookup(tops, F.col("home")), visits).otherwise(alone)).alias("at"))
    order = Window.partitionBy("bucket").orderBy("visitor", F.col("place").desc(), "tie", "text")
    dealt = dealt.select(F.col("at.bucket").alias("bucket"), F.col("at.visitor").alias("visitor"), "doc_id", "place", "text", F.xxhash64("text").alias("tie"))
    return dealt.select("bucket", F.row_number().over(order).alias("nth"), "visitor", "doc_id", "text", F.lead("text").over(order).alias("next"))


def edited(text: Column, after: Column) -> Column:
    """The text with the last half of its code points replaced by as many of the next text's first."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next, n_found).

    ``n_found``: of how many different fingerprints of documents the edited text's is within RADIUS bits, by the block tables.
    """
    rows = in_order(docs).withColumn("edited", edited(F.col("text"), F.coalesce("next", F.lit(""))))
    digest = F.sha2(F.col("edited").cast("binary"), 256)
    versions = F.array(F.struct(F.col("text").alias("text"), F.lit(None).cast("string").alias("sha")), F.struct(F.col("edited").alias("text"), digest.alias("sha")))
    of_doc = ["bucket", "nth", "visitor", "doc_id", "n_chars"]
    both = rows.select("bucket", "nth", "visitor", "doc_id", F.length("text").cast("long").alias("n_chars"), F.posexplode(versions).alias("which", "x"))
    both = both.select(*of_doc, "which", "x.sha", "x.text")
    fps = vote(both, [*of_doc, "which", "sha"]).groupBy(*of_doc)
    fps = fps.agg(F.max("sha").alias("edited_sha256"), F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"))
    following = F.lead("fp").over(Window.partitionBy("bucket").orderBy("nth"))
    out = cut_table(fps.withColumn("next_fp", following).where(~F.col("visitor")).drop("bucket", "nth", "visitor"))
    found = found_within(out.select(F.col("edited_fp").alias("fp")), out.select("fp"))
    out = out.join(found.withColumnRenamed("fp", "of"), F.col("edited_fp") == F.col("of"), "left")
    told = [likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next")]
    return out.select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", *told, F.coalesce("n", F.lit(0)).alias("n_found"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): documents with equal ids are taken together; a null id is a key like any other."""
    rows = docs.select(F.col("doc_id"), full_text().alias("text"))
    return vote(rows, ["doc_id"])


def _masks(radius: int, spare: int) -> list[int]:
    """The bits of each choice of ``spare`` of radius + spare blocks, signed."""
    blocks = radius + spare
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks)]
    keys = [sum(masks[k] for k in chosen) for chosen in combinations(range(blocks), spare)]
    return [m - (1 << 64) if m >> 63 else m for m in keys]


def _tables(prints: DataFrame, masks: list[int]) -> DataFrame:
    """(fp, t, key): each different fingerprint in each table."""
    return prints.select("fp").distinct().select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "key"))


def _met(a: Column, b: Column, table: Column, radius: int, masks: list[int]) -> Column:
    """Whether two fingerprints are within the radius and this is the first table in which they meet."""
    differ = a.bitwiseXOR(b)
    first = F.array_position(F.array(*[differ.bitwiseAND(F.lit(m).cast("long")) == 0 for m in masks]), True) - 1
    return (F.bit_count(differ) <= radius) & (table == first)


def found_within(asked: DataFrame, prints: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """(fp, n): of each different fingerprint asked for how many different ones of ``prints`` are within the radius."""
    masks = _masks(radius, spare)
    a, b = _tables(asked, masks).withColumnRenamed("fp", "a"), _tables(prints, masks).withColumnRenamed("fp", "b")
    met = a.join(b, ["t", "key"]).where(_met(F.col("a"), F.col("b"), F.col("t"), radius, masks))
    return met.groupBy(F.col("a").alias("fp")).agg(F.count("*").alias("n"))


def near_pairs(prints: DataFrame, radius: int = RADIUS, spare: int = SPARE) -> DataFrame:
    """(a, b, distance): pairs a < b of different fingerprints within the radius, each once. ``prints`` has the column fp.

    With radius + spare blocks, two such fingerprints agree in at least ``spare`` blocks. There is one table for
    each choice of ``spare`` blocks; a pair is taken in the first table that has it. More spare blocks make longer
    keys, and so smaller groups.
    """
    masks = _masks(radius, spare)
    one = _tables(prints, masks)
    a, b = one.withColumnRenamed("fp", "a"), one.withColumnRenamed("fp", "b")
    pairs = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & _met(F.col("a"), F.col("b"), F.col("t"), radius, masks))
    return pairs.select("a", "b", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("distance"))
