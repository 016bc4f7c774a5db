"""The pipeline's near stage goes through the index that the fingerprint operator has."""

from affinis.llm import simhash_gray


def test_near_copies_go_through_the_index(spark, monkeypatch):
    """fingerprints, index and components propose candidates, and exact sets confirm them; the tables propose the rest."""
    prints = [(1, 9, 0b1111), (2, 9, 0b1100), (3, 9, 0b0000), (4, 9, -1), (5, 9, 0b1111), (6, 9, 1 << 40 | 255)]
    keys = {r.node: r.key for r in simhash_gray.index_keys(spark.createDataFrame(prints, "node long, n int, fp long")).collect()}
    assert len(keys) == 6 and len({keys[k] for k in (1, 2, 3, 5)}) == 1 and len(set(keys.values())) == 3
    asked, links = [], simhash_gray.links
    monkeypatch.setattr(simhash_gray, "links", lambda nodes, radius, *a: asked.append((nodes.count(), radius)) or links(nodes, radius, *a))
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(words), " ".join(words[:299]), " ".join(words[:150] + ["x"] * 150), "", None, "one two", "one two three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in simhash_gray.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}
    assert asked == [(6, simhash_gray.RADIUS)]
