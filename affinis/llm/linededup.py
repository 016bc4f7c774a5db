"""Line deduplication by a segment-partition edit join, on DataFrame functions alone.

Lines are the parts of a text between line feeds. Equal lines are one; of different lines of MIN_CHARS code
points or more, those within EDITS edits are linked: each is split into EDITS + 1 segments, one of which must
stand unchanged in the other, at one of a few places that the lengths allow. Hashes of (length, segment,
characters) find the candidates, and a bit-parallel edit distance in a band of the threshold's width verifies them.
With one edit, lines that share a hash with more than SMALL others are not paired but divided: what is left of the
line is split in two again, one half of which must be unchanged, until a group is small, or no more than a character
is open; lines of such a group are near each other, so each is linked to the first alone. The pairs thus grow with
the lines, whatever they share, and no link is lost. (With more edits, which no query asks for, groups are paired in
full.) Linked lines form classes; of each class the first line, by document and place, stays, and the others go.

Defined results: empty lines always stay; a null text stays null and a text that loses all lines becomes
empty; shorter lines go only for an equal one; rows of equal id and text are one document, and are treated
alike; null ids come first; an empty table gives an empty result; long lines are lines like any other; columns
of the input never clash with those made here, because a row travels as one struct.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from affinis.llm.common import cut_table, full_text
from affinis.llm.components import connected_components

#: Edits between linked lines, and the least length of a line that is linked.
EDITS, MIN_CHARS = 1, 24
#: Lines that share a hash are compared in pairs if they are so many at most.
SMALL = 16
#: Before the edit distance of a pair, so many pieces of its lines are compared.
PIECES = 8
#: Up to so many candidate lines (some 10 MB of hashes) are broadcast to find their texts; beyond, they are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """(first place, size) of segment ``i``, both from 1, of a line of that length: the last ones are the longer."""
    parts = edits + 1
    base, longer = F.floor(length / parts).cast("int"), (length % parts).cast("int")
    extra = F.greatest(F.lit(0), F.lit(i - 1) - (F.lit(parts) - longer))
    size = base + F.when(F.lit(i) > F.lit(parts) - longer, 1).otherwise(0)
    return base * (i - 1) + extra + 1, size


def _key(line: Column, length: Column, i: int, at: Column, size: Column) -> Column:
    return F.xxhash64(F.lit(i), length, F.substring(line, at, size))


def _places(edits: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(segment, shift, how much shorter) of each of ``own_keys`` and of each of ``probe_keys``, in order."""
    own, probes = [(i, 0, 0) for i in range(1, edits + 2)], []
    for shorter in range(edits + 1):
        for i in range(1, edits + 2):
            low = max(-(i - 1), shorter - (edits + 1 - i))
            high = min(i - 1, shorter + (edits + 1 - i))
            probes += [(i, by, shorter) for by in range(low, high + 1) if shorter or by]
    return own, probes


def own_keys(line: Column, edits: int) -> Column:
    n = F.length(line)
    return F.array(*[_key(line, n, i, *_segment(n, i, edits)) for i in range(1, edits + 2)])


def probe_keys(line: Column, edits: int) -> Column:
    """Keys of the segments that a line of equal or smaller length may share, without the line's own."""
    n, keys = F.length(line), []
    for i, by, shorter in _places(edits)[1]:
        at, size = _segment(n - shorter, i, edits)
        keys.append(_key(line, n - shorter, i, at + by, size))
    return F.array(*keys)


def lines(docs: DataFrame) -> DataFrame:
    """(id, text_hash, no, line) of the lines that are not empty."""
    text = full_text()
    rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("no", "line"))
    return rows.where("line <> ''")


def _hashed(of_lines: DataFrame, *more: Column) -> DataFrame:
    return of_lines.select("id", "text_hash", "no", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(6)).alias("h2"), *more)


def _opened(hot: DataFrame) -> DataFrame:
    """(h1, line, own, m, s, e) of the members of groups by a segment, for one edit: it is in the other half, between s and e.

    Places are those of the shorter line, of m characters; a line that is no own one has one character more.
    """
    segment = F.when(F.col("own"), F.col("at") + 1).otherwise(F.get(F.array(*[F.lit(i) for i, _, _ in _places(1)[1]]), F.col("at")))
    rows = hot.select("h1", "line", "own", (F.length("line") - F.when(F.col("own"), 0).otherwise(1)).alias("m"), segment.alias("i"))
    half = F.floor(F.col("m") / 2).cast("int")
    first = F.col("i") == 1
    return rows.select("h1", "line", "own", "m", F.when(first, half).otherwise(0).alias("s"), F.when(first, F.col("m")).otherwise(half).alias("e"))


def _divided(rows: DataFrame) -> DataFrame:
    """(key, h1, own, line, m, s, e): each open part in two, of which one has the edit; the key is of all the rest.

    A part of one character has the other line's character before it or after it, if that line is longer.
    """
    s, e = F.col("s"), F.col("e")
    mid = F.floor((s + e) / 2).cast("int")
    halves = F.when(e - s > 1, F.array(F.struct(s.alias("s"), mid.alias("e")), F.struct(mid.alias("s"), e.alias("e"))))
    places = F.array(F.struct(s.alias("s"), s.alias("e")), F.struct(e.alias("s"), e.alias("e")))
    rows = rows.select("h1", "own", "line", "m", F.explode(F.coalesce(halves, places)).alias("x")).select("h1", "own", "line", "m", "x.s", "x.e")
    n = F.length("line")
    rest = (F.substring("line", F.lit(1), s), F.substring(F.col("line"), e + n - F.col("m") + 1, n))
    return rows.select(F.xxhash64("m", "s", "e", *rest).alias("key"), "h1", "own", "line", "m", "s", "e")


def _met(rows: DataFrame) -> DataFrame:
    """The rows (key, h1, own, ...) whose key has an own line and another one, with the key's count and its first own line."""
    sums = [F.count("*").alias("n"), F.min(F.when(F.col("own"), F.col("h1"))).alias("leader"), F.min("h1").alias("lo"), F.max("h1").alias("hi")]
    shared = cut_table(rows.groupBy("key").agg(*sums).where("leader IS NOT NULL AND lo < hi").select("key", "n", "leader"))
    few = shared.count() <= BROADCAST_LINES
    return cut_table(rows.join(F.broadcast(shared) if few else shared, "key"))


def _pairs(met: DataFrame, most: int | None) -> DataFrame:
    """(a, b): the candidates within groups of so many lines at most, of which one is the key's own."""
    few = met if most is None else met.where(F.col("n") <= most)
    a, b = few.where("own").select("key", F.col("h1").alias("a")), few.select("key", F.col("h1").alias("b"), "own")
    return a.join(b, "key").where((F.col("a") < F.col("b")) | (~F.col("own") & (F.col("a") != F.col("b")))).select("a", "b")


def candidates(known: DataFrame, text: Callable[[DataFrame], DataFrame], edits: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs of h1 that connect all lines within ``edits`` edits, and the texts of these, by ``text`` of a table of h1."""
    long_ones = known.where(F.col("own").isNotNull())
    own = long_ones.select(F.posexplode("own").alias("at", "key"), "h1", F.lit(True).alias("own"))
    met = _met(own.unionByName(long_ones.select(F.posexplode("probes").alias("at", "key"), "h1", F.lit(False).alias("own"))))
    texts = text(met.select("h1").distinct())
    most = SMALL if edits == 1 else None
    found = [_pairs(met, most)]
    hot = met.where(F.col("n") > SMALL if edits == 1 else F.lit(False))
    states = _opened(hot.join(texts.select("h1", "line"), "h1"))
    while not hot.isEmpty():
        met = _met(_divided(states))
        found.append(_pairs(met, most))
        crowd, width = met.where(F.col("n") > SMALL), F.col("e") - F.col("s")
        near = (width == 0) | (width == 1) & F.col("own")  # one character apart at most, and so are all such of the group
        found.append(crowd.where(near & (F.col("h1") != F.col("leader"))).select(F.col("leader").alias("a"), F.col("h1").alias("b")))
        states = hot = crowd.where(width > 0).select("h1", "line", "own", "m", "s", "e")
    every = reduce(DataFrame.unionByName, found)
    return cut_table(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), texts


def pieces_agree(a: Column, b: Column, edits: int) -> Column:
    """True of all lines within ``edits`` edits, and of few others: of PIECES pieces of one all but so many stand in the other, about where they were."""
    parts = max(PIECES, edits + 1)
    same = F.lit(0)
    for i in range(1, parts + 1):
        at, size = _segment(F.length(a), i, parts - 1)
        piece = F.substring(a, at, size)
        found = [F.substring(b, at + by, size) == piece for by in range(-edits, edits + 1)]
        same = same + reduce(Column.__or__, found).cast("int")
    return same >= parts - edits


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines are within ``edits`` edits: bit vectors of the differences along a column, in a band of 2 * edits + 1 rows.

    Bit t of the window at place j of the longer line is place j - edits + t of the shorter one. The window slides down with j;
    the distance is followed along its last row, and from where that has passed the shorter line's end, along the end.
    """
    full = (1 << 2 * edits + 1) - 1
    start = ((1 << edits + 1) - 1) << edits

    def distance(x: Column) -> Column:
        m, n = F.size(x["a"]), F.size(x["b"])

        def step(state: Column, j: Column) -> Column:
            c = F.get(x["b"], j - 1)
            match = F.lit(0).cast("long")
            for t in range(2 * edits + 1):
                match = match.bitwiseOR(F.when(F.get(x["a"], j - edits + t - 1) == c, 1 << t).otherwise(0).cast("long"))
            first = F.struct(state["vp"].alias("vp"), state["vn"].alias("vn"), state["score"].alias("score"), match.alias("eq"))
            return F.get(F.transform(F.array(first), lambda y: diagonal(y, j)), F.lit(0))

        def diagonal(y: Column, j: Column) -> Column:
            vp, eq = y["vp"], y["eq"]
            d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(y["vn"]).bitwiseAND(F.lit(full))
            inner = F.struct(vp.alias("vp"), y["vn"].alias("vn"), y["score"].alias("score"), d0.alias("d0"))
            return F.get(F.transform(F.array(inner), lambda z: horizontal(z, j)), F.lit(0))

        def horizontal(z: Column, j: Column) -> Column:
            vp, d0 = z["vp"], z["d0"]
            hp = z["vn"].bitwiseOR(F.lit(full).bitwiseAND(F.bitwise_not(d0.bitwiseOR(vp))))
            hn = d0.bitwiseAND(vp)
            down = F.shiftrightunsigned(d0, 1)
            row = F.greatest(F.lit(0), m - j + edits).cast("int")  # the end's place in the window, once it is there
            bit = F.element_at(F.array(*[F.lit(1 << t) for t in range(2 * edits + 1)]), F.least(row, F.lit(2 * edits)) + 1)
            at_end = hp.bitwiseAND(bit).cast("boolean").cast("int") - hn.bitwiseAND(bit).cast("boolean").cast("int")
            along = F.when(d0.bitwiseAND(F.lit(1 << 2 * edits)) == 0, 1).otherwise(0)
            new = z["score"] + F.when(j + edits <= m, along).otherwise(at_end)
            return F.struct(hn.bitwiseOR(F.lit(full).bitwiseAND(F.bitwise_not(down.bitwiseOR(hp)))).alias("vp"), down.bitwiseAND(hp).alias("vn"), new.cast("int").alias("score"))

        zero = F.struct(F.lit(start).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(edits)).cast("int").alias("score"))
        return F.aggregate(F.sequence(F.lit(1), n), zero, step, lambda state: state["score"])

    near = F.abs(F.length(a) - F.length(b)) <= edits
    swapped = F.length(a) > F.length(b)
    both = F.struct(F.split(F.when(swapped, b).otherwise(a), "").alias("a"), F.split(F.when(swapped, a).otherwise(b), "").alias("b"))
    some = (F.length(a) > 0) & (F.length(b) > 0)
    told = F.get(F.transform(F.array(both), distance), F.lit(0)) <= edits
    return F.when(~near, False).when(~some, True).when(~pieces_agree(a, b, edits), False).otherwise(told)


def links(docs: DataFrame, known: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(a, b): names of different lines within ``edits`` edits, enough to connect all such. ``known``: (h1, own, probes) of each line."""

    def text(wanted: DataFrame) -> DataFrame:
        wanted = cut_table(wanted)
        few = wanted.count() <= BROADCAST_LINES
        rows = _hashed(lines(docs), F.col("line")).select("h1", "h2", "line").where(F.length("line") >= min_chars)
        return cut_table(rows.join(F.broadcast(wanted) if few else wanted, "h1").groupBy("h1", "h2").agg(F.min("line").alias("line")))

    pairs, texts = candidates(known, text, edits)
    a = texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("a_line"))
    b = texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("b_line"))
    near = pairs.join(a, "a").join(b, "b").where(within(F.col("a_line"), F.col("b_line"), edits))
    return near.select(name(F.col("a"), F.col("a2")).alias("a"), name(F.col("b"), F.col("b2")).alias("b"))


def name(h1: Column, h2: Column) -> Column:
    return F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0"))


def superfluous(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, text_hash, gone array<int>): the numbers, from 0, of each document's lines that go."""
    near = F.length("line") >= min_chars
    of_lines = _hashed(lines(docs), F.when(near, own_keys(F.col("line"), edits)).alias("own"), F.when(near, probe_keys(F.col("line"), edits)).alias("probes"))
    found = of_lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "text_hash", "no")).alias("first"), F.count("*").alias("n"), F.first("own").alias("own"), F.first("probes").alias("probes"))
    known = cut_table(found)
    classes = cut_table(connected_components(links(docs, known, edits, min_chars)))
    linked = known.select("h1", "h2", "first", name(F.col("h1"), F.col("h2")).alias("node")).join(classes, "node")
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    linked = linked.join(heads, "component").select("h1", "h2", "head")
    # the first line of each class stays; of others, all but the first of equal ones go
    repeated = known.where("n > 1").select("h1", "h2", "first").join(linked.select("h1", "h2"), ["h1", "h2"], "left_anti").withColumnRenamed("first", "head")
    decided = linked.unionByName(repeated)
    gone = _hashed(lines(docs)).join(decided, ["h1", "h2"]).where(F.struct("id", "text_hash", "no") != F.col("head"))
    return gone.groupBy("id", "text_hash").agg(F.array_distinct(F.collect_list("no")).alias("gone"))


def drop_repeated_lines(docs: DataFrame, keep: list[str] | None = None, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc struct of the columns in ``keep``, text without the lines that go, n_lines, n_gone)."""
    gone = superfluous(docs, edits, min_chars).select(F.col("id").alias("of"), F.col("text_hash").alias("of_text"), "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (keep or docs.columns)]).alias("doc"), F.col("doc_id").alias("id"), F.xxhash64(full_text()).alias("text_hash"), F.col("text").alias("text"))
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("of_text")), "left")
    split = F.split(F.col("text"), "\n")
    stays = F.array_join(F.filter(split, lambda x, i: ~F.array_contains(F.col("gone"), i)), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(stays)
    return rows.select("doc", text.alias("text"), F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"))
