"""Each operator against a plain version on small tables, with the odd cases: nulls, empty and very long texts, ties, repeats, no rows, other columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("affinis.llm")

from pyspark.sql import functions as F

from affinis.llm import ann, bpe, fingerprint, langid, linededup, mixing, pii, quality, sharding, simhash_gray
from affinis.llm.components import connected_components
from affinis.llm.queries import QUERIES, bpe_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, target string, score string"
WORDS = {
    "en": "the of and to in that is was for with this from have they which their would about there could".split(),
    "fr": "le la les des une dans pour que qui sur avec est pas plus par mais nous vous leur cette".split(),
}


def prose(lang: str, n: int, seed: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS[lang]) + ("." if pick.random() < 0.1 else "") for _ in range(n))


def rows() -> list[tuple]:
    out = []
    for i in range(60):
        lang = "en" if i % 3 else "fr"
        out.append((i, prose(lang, 30 + i, i), lang, f"s{i % 4}"))
    out += [
        (100, None, "en", "s0"),
        (101, "", "en", None),
        (102, " \n\t ", None, "s1"),
        (103, "12 345 !!", "fr", "é"),
        (104, prose("en", 40_000, 9), "en", "s2"),
        (105, out[5][1], "en", "s2"),
        (5, out[5][1], "en", "s1"),
        (106, "one", None, None),
        (None, "a text without an id, of some words that no other has", "en", "s3"),
        (107, "日本語 \U0001f600 ÀÉ x\x0bx " * 3, "fr", "s3"),
    ]
    return [(*r, len(r[1]) if r[1] else 0, "x", "y", "z", "w") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def of_doc(df, *columns):
    return df.select("doc.doc_id", *columns).collect()


# 1
def test_bpe_is_what_tiktoken_gives(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    path, pattern = bpe_files()
    ranks = bpe.load_ranks(path)
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Tokenizer(ranks, pattern)
    pick = random.Random(1)
    texts = ["".join(pick.choice("aab  \n\t'stre1é日!?　\x85\x1c") for _ in range(pick.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 5000, "ab" * 3000, "".join(pick.choice("abcdeth") for _ in range(20_000)), "<|endoftext|>", None, ""]
    assert list(own.encode_batch(texts)) == [plain.encode_ordinary(t or "") for t in texts]
    encoded = bpe.encode(docs, path, pattern, ["doc_id", "text"])
    for row in encoded.collect():
        assert row.ids == plain.encode_ordinary(row.doc.text or "")
    for row in bpe.decode(encoded, path, pattern).collect():
        assert bytes(row.decoded).decode() == (row.doc.text or "")
    for row in bpe.round_trip(docs, path, pattern, ["text"], with_ids=True).collect():
        assert row.n_tokens == len(row.ids) and row.decoded_sha256 == hashlib.sha256((row.doc.text or "").encode()).hexdigest()
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, row.ids)).encode()).hexdigest()


def test_bpe_cache_turns_over(monkeypatch):
    path, pattern = bpe_files()
    monkeypatch.setattr(bpe, "CACHE_PIECES", 20)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 30)
    own = bpe.Tokenizer(bpe.load_ranks(path), pattern)
    texts = [prose("en", 30, i) + " unusualwordnumber" + "x" * i for i in range(60)]
    fresh = bpe.Tokenizer(own.ranks, pattern)
    assert list(own.encode_batch(texts)) == [list(next(fresh.encode_batch([t]))) for t in texts]


def test_rank_bits():
    bits, pick, held = bpe.RankBits(50_000), random.Random(2), set()
    for _ in range(2000):
        if held and pick.random() < 0.45:
            assert bits.pop_first() == min(held)
            held.remove(min(held))
        else:
            x = pick.randrange(50_000)
            held.add(x)
            bits.add(x)
    while held:
        assert bits.pop_first() == min(held)
        held.remove(min(held))
    assert bits.pop_first() == -1


# 2
def test_mix(docs, none):
    got = mixing.plan_mix(docs, ["doc_id", "source"]).collect()
    size = Counter()
    for r in rows():
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted([s for s in size if s is not None]) + ([None] if None in size else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    total = 1.5 * sum(size.values())
    while True:
        left = total - sum(2 * size[s] for s in full)
        open_ = sum(weight[s] for s in order if s not in full)
        target = {s: 2.0 * size[s] if s in full else left * weight[s] / open_ for s in order}
        over = {s for s in order if s not in full and target[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    for r in got:
        assert r.source_size == size[r.doc.source] and r.target == pytest.approx(target[r.doc.source])
        assert 0 <= r["copies"] <= 2
    assert got and len(got) == len(rows())
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan_mix(docs.repartition(7), ["doc_id", "source"]).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(none).count() == 0


def test_mix_joins_many_sources(docs, monkeypatch):
    want = sorted(map(str, mixing.plan_mix(docs, ["doc_id"]).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(str, mixing.plan_mix(docs, ["doc_id"]).collect())) == want


# 3
def test_shards(spark, docs, none):
    many = spark.createDataFrame([(i, ("copy" if i % 3 == 0 else f"text {i} " * (i % 50 + 1))) for i in range(3000)], "doc_id long, text string")
    got = sharding.shard(many, 24, ["doc_id", "text"]).collect()
    assert len(got) == 3000
    by, n = Counter(), {}
    for r in got:
        assert r["size"] == len(r.doc.text) + 8 and r.text_crc32 == zlib.crc32(r.doc.text.encode())
        by[r.shard] += r["size"]
        n.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in n.values()) and len(n) == 24
    assert max(by.values()) - min(by.values()) <= 2 * max(r["size"] for r in got)
    again = sharding.shard(many.repartition(5), 24, ["doc_id", "text"]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    odd = sharding.shard(docs, 4, ["doc_id"]).collect()
    assert len(odd) == len(rows()) and {r.text_crc32 for r in odd if r.doc.doc_id in (100, 101)} == {0}
    assert sharding.shard(none).count() == 0


@pytest.mark.parametrize("clash", [True, False])
def test_written_shards(spark, tmp_path, clash):
    more = "shard long, Slot string, _shard long" if clash else "other long"
    data = [(i, f"text {i % 40}", *([i, "x", -i] if clash else [i])) for i in range(200)]
    docs = spark.createDataFrame(data, f"doc_id long, text string, {more}")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    by, place = ("__shard", "_slot") if clash else ("shard", "slot")
    assert set(got.columns) == {*docs.columns, by, place}
    assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    for k in range(4):
        assert sorted(r[place] for r in got.where(F.col(by) == k).collect()) == list(range(got.where(F.col(by) == k).count()))


def test_overfull_ranges_are_divided(spark, monkeypatch):
    many = spark.createDataFrame([(i, "copy" if i % 2 else f"t{i}") for i in range(4000)], "doc_id long, text string")
    monkeypatch.setattr(sharding, "SAMPLES_PER_RANGE", 1)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 100)
    skeleton = sharding.sized(many, ["doc_id"]).select("id", "size", "text_crc32", "key")
    splitters, filled = sharding.find_splitters(skeleton, 4)
    assert max(n for _, _, n in filled) <= 400 and sum(n for _, _, n in filled) == 4000


# 4
def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((700, 16))
    data = [(i, [float(x) for x in v[i]]) for i in range(700)]
    data += [(800, data[100][1]), (801, data[100][1]), (900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [None] * 16), (904, [1.0, 2.0]), (200, data[200][1])]
    got = ann.nearest(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect()
    fine = [(i, np.array(x)) for i, x in data if i not in (900, 901, 902, 903, 904)]
    hit = total = 0
    for q in [*range(0, 700, 100), 800]:
        own = dict(fine)[q]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        want = sorted((float(np.sqrt(((x - own) ** 2).sum())), i) for i, x in fine if i != q)[:10]
        assert [r[0] for r in mine] == list(range(1, len(mine) + 1))
        for _, i, s in mine:
            assert any(j == i and s == pytest.approx(float(np.sqrt(((x - own) ** 2).sum())), abs=1e-12) for j, x in fine)
        hit, total = hit + len({i for _, i in want} & {i for _, i, _ in mine}), total + 10
    assert hit / total >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 100][:2] == [800, 801]
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).count() == 0
    few = ann.nearest(spark.createDataFrame(data[:4], "vec_id long, embedding array<double>"), F.col("id") == 0).collect()
    assert len(few) == 3


@pytest.mark.parametrize("clustered", [True, False])
def test_nearest_over_blocks(spark, monkeypatch, clustered):
    """Blocks of 200: recall in both kinds of data, and of clusters few blocks for each query."""
    monkeypatch.setattr(ann, "BLOCK", 200)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal((40, 24)) * 4
    v = centre[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 24)) if clustered else rng.standard_normal((4000, 24))
    v[1000:1600] = v[1000]  # a very common vector
    pairs = []

    def counted(kept, asks, k, searched=ann._searched):
        pairs.append(asks.count())
        return searched(kept, asks, k)

    monkeypatch.setattr(ann, "_searched", counted)
    got = ann.nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), F.col("id") % 100 == 0).collect()
    hit = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        own = sorted((r["rank"], r.score) for r in got if r.query_id == q)
        assert [x for x, _ in own] == list(range(1, 11))
        hit += sum(s <= np.sort(d)[9] + 1e-9 for _, s in own)
    assert hit / 400 >= 0.9
    assert pairs[0] == 40 and (pairs[1] < 40 * 8 if clustered else pairs[1] > 40 * 10)


# 5
def plain_fingerprint(text, width=3):
    words = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).split()
    import xxhash

    items = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in items]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in edges:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(spark, docs, none):
    texts = [(r[0], r[1]) for r in rows() if r[0] is not None and r[0] != 104]
    base = prose("en", 400, 77)
    for k in range(30):
        words = base.split()
        words[(k * 13) % 400] = f"w{k}"
        texts.append((1000 + k, " ".join(words)))
    got = {(r.doc.doc_id, r.doc.text): (r.fp, r.component_id) for r in simhash_gray.components(spark.createDataFrame(texts, "doc_id long, text string"), ["doc_id", "text"]).collect()}
    fps = [plain_fingerprint(t) for _, t in texts]
    edges = [(i, j) for i in range(len(texts)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    root = plain_components(len(texts), edges)
    least = {}
    for (i, _), r in zip(texts, root):
        least[r] = min(least.get(r, i), i)
    for (i, t), f, r in zip(texts, fps, root):
        assert got[i, t][0] % (1 << 64) == f and got[i, t][1] == least[r]
    assert simhash_gray.components(none, ["doc_id"]).count() == 0
    assert simhash_gray.components(docs, ["doc_id"]).count() == len(rows())


def test_gray_walk_loses_no_link():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for _ in range(4):
        f = np.concatenate([f, f[:400] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))])
    f = np.unique(f)
    for radius in (0, 1, 2, 4):
        i, j = simhash_gray.local_links(f, np.zeros(len(f), int), True, radius)
        want = [(a, b) for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= radius)) if a != b]
        assert plain_components(len(f), zip(i, j)) == plain_components(len(f), want)
        side = np.arange(len(f)) % 2
        i, j = simhash_gray.local_links(f, side, False, radius)
        assert plain_components(len(f), zip(i, j)) == plain_components(len(f), [(a, b) for a, b in want if side[a] != side[b]])


def test_links_over_parts(spark):
    rng = np.random.default_rng(1)
    f = rng.integers(0, 2**64, 200, dtype=np.uint64)
    f = np.unique(np.concatenate([f, f ^ np.uint64(1 << 63), f ^ np.uint64(3)]))
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(f.view(np.int64))], "node long, fp long")
    got = [(r.a, r.b) for r in simhash_gray.links(nodes, 2, part=50).collect()]
    want = [(a, b) for a, b in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 2)) if a != b]
    assert plain_components(len(f), got) == plain_components(len(f), want)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 300), (300, 200), (500, 500)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_one(spark, docs, none):
    base = [f"w{i * 7919 % 1009}" for i in range(300)]
    near = base[:]
    near[150] = "other"
    far = [f"v{i * 7919 % 1009}" for i in range(300)]
    data = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(far)), (7, " ".join(base)), (7, " ".join(base)), (8, " ".join(far[:150] + base[150:])), (None, " ".join(base)), (9, ""), (10, None)]
    got = simhash_gray.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "2", "8", "9", "None"])
    assert simhash_gray.keep_one(none).count() == 0
    kept = simhash_gray.keep_one(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 1 and kept.where("doc_id = 105").count() == 0


# 6
def plain_lines(data, edits=1, least=24):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    first = {}
    for i, text in sorted(data):
        for n, line in enumerate((text or "").split("\n")):
            if line:
                first.setdefault(line, (i, n))
    lines = list(first)
    long_ones = [k for k, x in enumerate(lines) if len(x) >= least]
    edges = [(a, b) for a in long_ones for b in long_ones if a < b and abs(len(lines[a]) - len(lines[b])) <= edits and distance(lines[a], lines[b]) <= edits]
    root = plain_components(len(lines), edges)
    head = {}
    for k, r in enumerate(root):
        head[r] = min(head.get(r, first[lines[k]]), first[lines[k]])
    at = {x: head[r] for x, r in zip(lines, root)}
    return {i: "\n".join(x for n, x in enumerate((t or "").split("\n")) if not x or at[x] == (i, n)) for i, t in data}


@pytest.mark.parametrize(("edits", "small"), [(1, 16), (2, 16), (1, 1)])
def test_line_dedup(spark, none, monkeypatch, edits, small):
    """With groups divided if they have more than one line, too."""
    monkeypatch.setattr(linededup, "SMALL", small)
    pick = random.Random(edits)
    base = ["".join(pick.choice("abé d") for _ in range(pick.randint(22, 32))) for _ in range(12)]
    data = []
    for i in range(40):
        lines = []
        for _ in range(pick.randint(0, 6)):
            x = list(pick.choice(base))
            for _ in range(pick.randint(0, edits + 1)):
                k = pick.randrange(len(x))
                x[k : k + pick.randint(0, 1)] = pick.choice(["", "z", "q"])
            lines.append("".join(x))
        data.append((i, "\n".join(lines + ["", "short"][: pick.randint(0, 2)])))
    data += [(50, None), (51, ""), (52, "\n\n"), (53, base[0] * 40), (54, base[0] * 40 + "x")]
    df = spark.createDataFrame([(*x, "c") for x in data], "doc_id long, text string, line string").repartition(3)
    got = linededup.drop_repeated_lines(df, ["doc_id", "line"], edits).collect()
    want = plain_lines(data, edits)
    assert {r.doc.doc_id: r.text or "" for r in got} == want
    assert {r.doc.doc_id for r in got if r.text is None} == {50}
    assert linededup.drop_repeated_lines(none).count() == 0


def test_a_hot_group_makes_few_pairs(spark, monkeypatch):
    """5,000 lines with one first half: half of them a counter's, each within an edit of others, half without a near one but for 40 copies."""
    pick = random.Random(1)
    head = "".join(pick.choice("abcdefgh ") for _ in range(32))
    words = ["".join(pick.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(2460)]
    near = [x[:9] + "Z" + x[9 + k % 2 :] for k, x in enumerate(words[:40])]
    tails = [f"counted {k:04d} of all these things" for k in range(2500)] + words + near
    made = []

    def counted(met, most, pairs=linededup._pairs):
        made.append(pairs(met, most).count())
        return pairs(met, most)

    monkeypatch.setattr(linededup, "_pairs", counted)
    df = spark.createDataFrame([(i, head + t) for i, t in enumerate(tails)], "doc_id long, text string")
    got = {r.doc.doc_id: r.n_gone for r in linededup.drop_repeated_lines(df, ["doc_id"]).collect()}
    assert sorted(i for i, n in got.items() if not n) == [0, *range(2500, 4960)]
    assert sum(made) <= 5000 * linededup.SMALL


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_vectors_give_the_edit_distance(spark, edits):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    pick, data = random.Random(edits), []
    for _ in range(1500):
        x = [pick.choice("ab\U0001f600é") for _ in range(pick.randint(0, 14))]
        y = list(x)
        for _ in range(pick.randint(0, 4)):
            k = pick.randrange(len(y) + 1)
            y[k : k + pick.randint(0, 1)] = pick.choice(["", "a", "zz"])
        data.append(("".join(x), "".join(y)))
    got = spark.createDataFrame(data, "a string, b string").select("a", "b", linededup.within(F.col("a"), F.col("b"), edits).alias("near")).collect()
    assert [r for r in got if r.near != (distance(r.a, r.b) <= edits)] == []


def test_very_long_lines(spark):
    line = prose("en", 12_000, 3)
    data = [(1, line), (2, line[:30_000] + "Q" + line[30_000:]), (3, line[:40_000] + "QQQ" + line[40_003:])]
    got = linededup.drop_repeated_lines(spark.createDataFrame(data, "doc_id long, text string"), ["doc_id"]).collect()
    assert {r.doc.doc_id: r.n_gone for r in got} == {1: 0, 2: 1, 3: 0}


# 7
def test_fingerprints_of_edits(spark, docs, none, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_ROWS", 7)
    data = [(r[0], r[1]) for r in rows() if r[0] is not None and not (r[0] == 5 and r[3] == "s1" and r[1] != rows()[5][1])]
    data = list(dict.fromkeys(data))
    got = {r.doc_id: r for r in fingerprint.compare_with_next(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    ordered = sorted(data, reverse=True)
    for k, (i, text) in enumerate(ordered):
        text, after = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        r, following = got[i], got[ordered[(k + 1) % len(ordered)][0]]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.near_next == 1 - ((r.fp ^ following.fp) % (1 << 64)).bit_count() / 64
        assert r.near_edited == 1 - ((r.fp ^ r.edited_fp) % (1 << 64)).bit_count() / 64
        assert r.n_found == len({x.fp for x in got.values() if ((x.fp ^ r.edited_fp) % (1 << 64)).bit_count() <= 3})
    assert got[5].fp == got[105].fp and got[100].fp == got[101].fp == 0
    assert {r.n_found for r in got.values()} > {0}
    one = fingerprint.compare_with_next(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0
    assert fingerprint.compare_with_next(none).count() == 0
    assert fingerprint.compare_with_next(docs).count() == len(rows())


def test_long_texts_vote_in_parts(spark, monkeypatch):
    text = prose("en", 3000, 5)
    whole = fingerprint.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().fp
    data = spark.createDataFrame([(1, text)], "k long, text string")
    terms = [r.term for r in data.select(F.explode(fingerprint._terms(F.col("text"))).alias("term")).collect()]
    bits = [r.h for r in spark.createDataFrame([(t,) for t in terms], "t long").select(F.xxhash64(F.shiftrightunsigned("t", 5)).alias("h")).collect()]
    weight = [t & 31 for t in terms]
    total = sum(weight)
    assert whole % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(w for w, h in zip(weight, bits) if h >> b & 1) > total)


def test_block_tables(spark):
    rng = np.random.default_rng(2)
    f = rng.integers(0, 2**64, 150, dtype=np.uint64)
    for _ in range(4):
        f = np.concatenate([f, f[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))])
    f = np.unique(f)
    got = fingerprint.near_pairs(spark.createDataFrame([(int(x),) for x in np.repeat(f, 2).view(np.int64)], "fp long")).collect()
    s = f.view(np.int64)
    want = {(int(min(s[i], s[j])), int(max(s[i], s[j]))) for i, j in zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f[None]) <= 3)) if i != j}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want


# 8
def test_language(docs, none):
    got = {(r.doc.doc_id, r.doc.text): r for r in langid.identify(docs, ["doc_id", "text", "lang"]).collect()}
    clean = [r for r in got.values() if r.doc.doc_id is not None and r.doc.doc_id < 60]
    assert all(r.lang_pred == r.doc.lang for r in clean) and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.lang_pred == "und" and r.score == 0 for r in got.values() if r.doc.doc_id in (100, 101, 102, 103))
    assert langid.identify(none).count() == 0


@pytest.mark.parametrize("piece", [7, 50, 101])
def test_language_pieces_change_nothing(monkeypatch, piece):
    texts = [prose("en", 200, 1), prose("fr", 300, 2), "", None] + [prose("en", 80, 5)[: k * piece + by] for k in (1, 2) for by in range(-1, 4)]
    model = (["en", "fr"], np.random.default_rng(0).standard_normal((2, 1 << langid.BITS)).astype(np.float32), np.zeros(2))
    names, share = langid.score(texts, *model)
    monkeypatch.setattr(langid, "PIECE", piece)
    again, same = langid.score(texts, *model)
    assert names == again and np.allclose(share, same, rtol=1e-12, atol=0)


def test_language_scores_are_those_of_a_plain_model(spark):
    """Each text's n-grams one by one: smoothed counts of the learned documents, tempered, against the share that the operator gives."""
    data = [(i, prose("en" if i % 3 else "fr", 5 + i % 40, i).replace("the", "The2") + (" É" if i % 7 == 0 else ""), "en" if i % 3 else "fr") for i in range(200)]
    data += [(300, "x", "en"), (301, "1 2", "fr"), (302, None, "fr"), (303, "the le", None)]
    got = {r.doc.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string"), ["doc_id"]).collect()}

    def grams(text):
        codes = [ord(c.lower()) if c.isalpha() else 32 for c in text or ""] + [32, 32]
        for at in range(len(codes) - 2):
            h = 0
            for k in range(3):
                h = (h + codes[at + k] + k + 1) * 0x9E3779B1 % (1 << 32)
                h ^= h >> 15
                if any(c != 32 for c in codes[at : at + k + 1]):
                    yield (h * 0x85EBCA77 % (1 << 32)) >> (32 - langid.BITS)

    learned = [(t, lang) for i, t, lang in data if lang and t is not None and zlib.crc32(str(i).encode()) % 5]
    counts = {x: Counter(g for t, lang in learned if lang == x for g in grams(t)) for x in ("en", "fr")}
    prior = {x: sum(lang == x for _, lang in learned) for x in counts}
    for i, text, _ in data:
        if not any(c.isalpha() for c in text or ""):
            assert got[i] == ("und", 0.0)
            continue
        own = list(grams(text))
        value = {}
        for x, c in counts.items():
            total = sum(c.values()) + langid.SMOOTHING * (1 << langid.BITS)
            mean = sum(np.log((c[g] + langid.SMOOTHING) / total) for g in own) / len(own)
            value[x] = mean * min(len(own), langid.EVIDENCE) + np.log(prior[x] / sum(prior.values()))
        best = max(value, key=value.get)
        assert got[i][0] == best and got[i][1] == pytest.approx(1 / sum(np.exp(v - value[best]) for v in value.values()), abs=1e-4)


# 9
CARD = "4111 1111 1111 1111"


def plain_base(text):
    """The patterns as they are stated."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        if 16 <= len(digits) <= 19 and luhn % 10 == 0:
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def pii_texts():
    text = "mail a.b+c@x-y.co.uk, 10.0.0.255 256.1.1.1 1.2.3.4.5, " + CARD + ", 4111111111111112 +1 (555) 555-0100 +12 a@b"
    pick = random.Random(9)
    parts = ["a", "B.", "@", "x.co", ".", "-", "%", "é", " ", "\n", "1", "25", "300", "10.0.0.1", ".7", CARD, "4111-1111-1111-1111", "+1", "+44 20 7946 0958", "(555) ", "0"]
    return [text] + ["".join(pick.choice(parts) for _ in range(pick.randint(0, 25))) for _ in range(4000)]


def test_base_spans_are_the_patterns():
    assert [(pii.KINDS[k], pii_texts()[0][a:b]) for k, a, b in pii.base_spans(pii_texts()[0])] == [("email", "a.b+c@x-y.co.uk"), ("ip", "10.0.0.255"), ("ip", "1.2.3.4"), ("card", CARD), ("phone", "+1 (555) 555-0100")]
    for text in pii_texts():
        assert pii.base_spans(text) == plain_base(text)


def test_the_query_writes_the_spans(spark, tmp_path):
    texts = pii_texts()[:300] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in QUERIES["op9_personal_data"](spark, str(tmp_path)).collect():
        base = plain_base(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in range(4)]
        written = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert set(written) <= set(spans) and spans == sorted(spans, key=lambda x: (pii.KINDS.index(x.split(":")[0]), int(x.split(":")[1]), int(x.split(":")[2])))


@pytest.mark.parametrize("text", ["1" + "-" * 10**6 + "x", "a" * 10**6 + "@", "1" * 10**6, "a@" * 500_000, "+1" + "(" * 10**6, "1." * 500_000, "x@" + "a." * 500_000, "1 " * 100_000, "." * 10**6 + "1"])
def test_long_tokens_take_linear_time(text):
    import time

    field, began = pii.fit([]), time.process_time()
    pii.find_spans(text, field)
    assert time.process_time() - began < (30 if " " in text else 5)


def ties_corpus():
    """Numbers like 555-0100 are a phone's after +1 800, and part numbers else; texts have the ones or the others, and most have years."""
    pick = random.Random(3)
    number = lambda: f"{pick.randint(200, 999)}-{pick.randint(1000, 9999)}"
    out = []
    for i in range(1500):
        a = number()
        if i % 15 == 0:
            out.append(f"call +1 800 {a} or, later, also +1 800 {a} or else, at night, +1 800 {number()} then")
        elif i % 15 < 5:
            out.append(f"part {number()} and later some other part {number()} of those")
        else:
            out.append(f"in {pick.randint(1900, 2030)} there were {pick.randint(10, 99)} of them, but {pick.randint(100, 999)} in {pick.randint(1900, 2030)}")
    return out


def test_ties_change_labels():
    counts = Counter()
    pii.count(ties_corpus(), counts)
    field = pii.fit(sorted((*k, n) for k, n in counts.items()))
    untied = pii.Field(field.weights, field.step, 0 * field.same, 0 * field.like)
    no_shape = pii.Field(field.weights, field.step, field.same, 0 * field.like)
    phone = pii.KINDS.index("phone") + 1
    assert field.same[phone, phone] > 1 and field.like[phone, phone] > 0.5
    same, shape, alone = "call +1 800 555-0100 today, but at night the number is 555-0100 here", "call +1 800 555-0100 today, but at night the number is 555-0199 here", "at night the number is 555-0100 here"
    told = lambda text, f: [text[a:b] for k, a, b in pii.find_spans(text, f)[1] if k == phone - 1]
    assert told(same, field) == ["555-0100"] and told(same, untied) == [] and told(same, no_shape) == ["555-0100"]
    assert told(shape, field) == ["555-0199"] and told(shape, no_shape) == [] and told(alone, field) == []


def test_field_adds_what_stands_beside_a_failed_match(spark, none):
    data = [(i, f"words here {'mail%d@site.org' % i} and 10.{i}.0.1 more, +1 (555) 555-0{100 + i} end") for i in range(60)]
    data += [(i, f"number 4012888888881881 stands alone, item {i} of 12 v2.0") for i in range(60, 120)]
    data += [(200, "odd 4012888888881881 10.1.2.3 tail"), (201, None), (202, ""), (203, "no data in 3 words of 2024")]
    got = {r.doc.doc_id: r for r in pii.personal_data(spark.createDataFrame(data, "doc_id long, text string"), ["doc_id", "text"]).collect()}
    odd = got[200]
    assert [(s.kind, odd.doc.text[s.start : s.end]) for s in odd.base] == [("ip", "10.1.2.3")]
    assert [(s.kind, odd.doc.text[s.start : s.end]) for s in odd.added] == [("card", "4012888888881881")]
    assert not got[203].added and not got[201].base and not got[202].base
    assert all(not got[i].added for i in range(60, 120))
    assert pii.personal_data(none).count() == 0


def test_belief_propagation_is_exact_on_a_chain():
    rng = np.random.default_rng(0)
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=(pii.LABELS, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)), np.zeros((pii.LABELS, pii.LABELS)))
    tokens = pii.Tokens("1a 22b 333")
    known = np.zeros(3, int)
    local, step = np.exp(tokens.features() @ field.weights), np.exp(field.step)
    joint = np.einsum("a,ab,b,bc,c->abc", local[0], step, local[1], step, local[2])
    joint /= joint.sum()
    got = field.beliefs(tokens, known)
    assert np.allclose(got[0], joint.sum((1, 2)), atol=1e-2) and np.allclose(got[1], joint.sum((0, 2)), atol=1e-2)


def test_belief_propagation_is_exact_on_ties():
    """Two tokens far apart that are equal, and a third of their shape: a chain of ties."""
    rng = np.random.default_rng(1)
    shape = (pii.LABELS, pii.LABELS)
    field = pii.Field(rng.normal(size=(pii.FEATURES, pii.LABELS)), rng.normal(size=shape), 2 * rng.normal(size=shape), 2 * rng.normal(size=shape))
    tokens = pii.Tokens("12-a then a good deal later 12-a and, far from both, 34-b")
    assert tokens.ties() == ([(0, 1)], [(1, 2)]) and not any(tokens.next_to)
    local = np.exp(tokens.features() @ field.weights)
    for held in (None, 2):
        known = np.array([0, 0, held or 0])
        own = local.copy()
        if held:
            own[2] = np.eye(pii.LABELS)[held]
        joint = np.einsum("a,ab,b,bc,c->abc", own[0], np.exp(field.same), own[1], np.exp(field.like), own[2])
        joint /= joint.sum()
        got = field.beliefs(tokens, known)
        for k, others in enumerate([(1, 2), (0, 2), (0, 1)]):
            assert np.allclose(got[k], joint.sum(others), atol=1e-3)


# 10
def test_quality(spark, docs, none):
    data, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = " ".join(w + "$$$" for w in prose("en", 30, i).split()) if bad else prose("en", 30, i)
        data.append((i, text))
        labels.append((i, int(not bad), 0))
    data += [(1000, None), (1001, ""), (1002, prose("en", 30_000, 1))]
    labels += [(3, None, 0), (7, 1, 0), (5000, 1, 0)]
    df, marks = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc.doc_id: r.score for r in quality.assess(df, marks, ["doc_id"]).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 4 != 0) for i in held]) > 0.97
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    assert {r.score for r in quality.assess(df, marks.where("quality = 1"), ["doc_id"]).collect()} != set()
    assert {r.score for r in quality.assess(df, marks.where("1 = 0"), ["doc_id"]).collect()} == {0.5}
    assert quality.assess(none, marks).count() == 0
    assert quality.assess(docs, marks).count() == len(rows())


@pytest.mark.parametrize("piece", [1, 5, 64, 1000])
def test_quality_pieces_change_nothing(monkeypatch, piece):
    """Also for words above a piece, and for each kind of white space."""
    pick = random.Random(piece)
    texts = [pick.choice(" \r\v\f\t\n").join(w + "Ab9é$" * pick.choice([0, 0, 1, 300]) for w in prose("en", 60, k).split()) for k in range(8)] + [" ", "a", "ab ", " Ab", "x" * 3000]
    stamp = np.zeros(1 << quality.BITS, np.int32)
    whole = [quality._words(t.encode()) for t in texts]
    found = [set(quality.features(t, stamp).tolist()) for t in texts]
    assert [len(h) for h, _ in whole] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]
    monkeypatch.setattr(quality, "PIECE", piece)
    for t, (h, shape), f in zip(texts, whole, found):
        again, kinds = quality._words(t.encode())
        assert np.array_equal(h, again) and np.array_equal(shape, kinds) and set(quality.features(t, stamp).tolist()) == f


def test_all_ten_are_registered():
    assert sorted(int(x[2:].split("_")[0]) for x in QUERIES) == list(range(1, 11))


def test_bands_lose_no_link_within_a_step():
    rng = np.random.default_rng(5)
    f = rng.integers(0, 2**64, 300, dtype=np.uint64)
    f = np.unique(np.concatenate([f, f ^ np.uint64(5), f ^ np.uint64(1 << 40)]))
    band, side = rng.integers(0, 4, len(f)), rng.integers(0, 2, len(f))
    near = np.bitwise_count(f[:, None] ^ f[None]) <= 3
    for same in (True, False):
        i, j = simhash_gray.local_links(f, side, same, 3, band=band)
        want = [(a, b) for a, b in zip(*np.nonzero(near)) if a != b and abs(band[a] - band[b]) <= 1 and (same or side[a] != side[b])]
        assert plain_components(len(f), zip(i, j)) == plain_components(len(f), want)


def test_near_copies_over_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash_gray, "links", lambda nodes, r, w, f=simhash_gray.links: f(nodes, r, w, part=20))
    data = []
    for k in range(40):
        base = [f"w{(i * 7919 + k * 31) % 5003}" for i in range(60 + 10 * k)]
        near = base[:]
        near[30] = "other"
        data += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(near))]
    got = {r.id: r.component_id for r in simhash_gray.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(got[2 * k + 1] == got[2 * k] == 2 * k for k in range(40)) >= 37


def shingles_of(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def edited(seed):
    """(text, text) pairs of 100 and 400 words: a passage appended, cut off, inserted or cut out, of similarities from 0.7 to 0.95."""
    rng = np.random.default_rng(seed)

    def words(n):
        return [f"w{x}" for x in rng.zipf(1.3, n) % 5000]

    for n in (100, 400):
        for share in (0.04, 0.08, 0.12, 0.16, 0.19, 0.21, 0.25, 0.3):
            for kind in range(4):
                base = words(n)
                k, at = int(n * share), int(rng.integers(n // 4, n // 2))
                yield " ".join(base), " ".join([base + words(int(k / (1 - share))), base[:-k], base[:at] + words(int(k / (1 - share))) + base[at:], base[:at] + base[at + k :]][kind])


def test_near_copies_of_every_kind_of_edit(spark):
    pairs = [p for seed in range(4) for p in edited(seed)]
    alike = [len(a & b) / len(a | b) for a, b in ((shingles_of(x), shingles_of(y)) for x, y in pairs)]
    data = [(2 * k + i, text) for k, p in enumerate(pairs) for i, text in enumerate(p)]
    got = {r.id: r.component_id for r in simhash_gray.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(0.8 <= x < 0.85 for x in alike) >= 20 and sum(x >= 0.85 for x in alike) >= 60
    assert [k for k, x in enumerate(alike) if x >= 0.8 and got[2 * k + 1] != 2 * k] == []


@pytest.mark.parametrize("block", [1 << 21, 600])
def test_near_copies_are_those_of_exact_similarities(spark, monkeypatch, block):
    """Groups about the threshold, whose members are like some others and not their leader, in one block and in several."""
    monkeypatch.setattr(simhash_gray, "BLOCK", block)
    rng = np.random.default_rng(3)
    texts = []
    for n in (30, 80, 200):
        base = [f"w{x}" for x in rng.integers(0, 3000, n)]
        for k in range(40):
            copy = base[:]
            for at in rng.integers(0, n, rng.integers(1, 1 + n // 25)):
                copy[at] = f"x{rng.integers(10**6)}"
            texts.append(" ".join(copy))
    sets = [shingles_of(t) for t in texts]
    like = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(texts)) for b in range(a)]
    assert sum(0.7 <= x < 0.8 for _, _, x in like) > 100
    got = {r.id: r.component_id for r in simhash_gray.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(texts))] == plain_components(len(texts), [(a, b) for a, b, x in like if x >= 0.8])


def test_a_repeated_id_loses_only_its_copy(spark):
    base, own = ([f"{x}{k * 7919 % 1009}" for k in range(200)] for x in "wv")
    data = [(1, base), (5, base[:-5]), (5, own), (9, own[:-5])]
    got = simhash_gray.keep_one(spark.createDataFrame([(i, " ".join(t)) for i, t in data], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, " ".join(base)), (5, " ".join(own))]
