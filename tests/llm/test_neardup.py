import random
from itertools import combinations

import pytest

from siftwell.functions.text import words
from siftwell.llm import neardup

SCHEMA = "doc_id string, stratum string, text string, class_id int, n string"


def shingle_set(text, k=5):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}


def brute(rows, threshold):
    seen = {}
    for doc, part, text, *_ in rows:
        if doc is not None:
            seen[doc] = (part, shingle_set(text or ""))
    out = set()
    for a, b in combinations(sorted(seen), 2):
        (pa, x), (pb, y) = seen[a], seen[b]
        if pa == pb and len(x & y) * 100 >= threshold * len(x | y):
            out.add((a, b))
    return out


def corpus(seed, n, vocabulary=400, hot=0):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(vocabulary)}"
    rows = []
    base = [word() for _ in range(120)]
    for i in range(n):
        kind = rng.random()
        if i < hot:
            text = list(base)
            for _ in range(rng.randrange(4)):
                text[rng.randrange(len(text))] = word()
        elif rows and kind < 0.4:
            text = rows[rng.randrange(len(rows))][2].split()
            for _ in range(rng.randrange(1, 6)):
                text.insert(rng.randrange(len(text)), word())
        else:
            text = [word() for _ in range(rng.randrange(3, 150))]
        rows.append((f"d{i:04d}", rng.choice(["A", "B"]), " ".join(text), i, "x"))
    return rows


@pytest.mark.parametrize("hot", [0, 60])
def test_pairs_equal_brute_force(spark, hot):
    rows = corpus(3, 180, hot=hot)
    df = spark.createDataFrame(rows, SCHEMA)
    members, links = neardup.near_duplicates(df, similarity="0.75", bucket_limit=8, max_depth=2, block=16)
    found = {(r.doc_id_a, r.doc_id_b) for r in neardup.duplicate_pairs(members, links).collect()}
    assert found == brute(rows, 75)


def test_edge_rows(spark):
    rows = [
        ("a", "A", None, 1, ""), ("b", "A", "", 1, ""), ("c", "A", "one two", 1, ""), ("d", "A", "One,  two!", 1, ""),
        ("e", None, "one two", 1, ""), ("f", None, "one two", 1, ""), (None, "A", "one two", 1, ""), ("c", "A", "one two", 1, ""),
        ("g", "A", "x y z " * 20_000, 1, ""), ("h", "A", "x y z " * 20_000 + "w", 1, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    members, links = neardup.near_duplicates(df)
    pairs = sorted((r.doc_id_a, r.doc_id_b) for r in neardup.duplicate_pairs(members, links).collect())
    assert pairs == [("a", "b"), ("c", "d"), ("e", "f")]
    assert members.count() == 8


def test_empty(spark):
    members, links = neardup.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert members.count() == links.count() == 0
    assert neardup.duplicate_groups(members, links).count() == 0


def test_groups_are_components(spark):
    rows = corpus(5, 120)
    members, links = neardup.near_duplicates(spark.createDataFrame(rows, SCHEMA), similarity="0.8")
    groups = {r.doc_id: r.group_id for r in neardup.duplicate_groups(members, links).collect()}
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in brute(rows, 80):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert groups == {d: root(d) for d in parent}


def test_runs_and_floor():
    assert neardup.runs_for(0.75, 0.9999) == 7
    assert 30 < neardup.sketch_floor(0.75) < 48
    assert 20 < neardup.slots_floor(0.75) < 48


def test_pairs_of_a_large_class(spark):
    members = spark.createDataFrame([(f"d{i:04d}", "A", "d0000") for i in range(300)] + [("e", "A", "e")], "doc_id string, part string, class_id string")
    links = spark.createDataFrame([("d0000", "e")], "class_id_a string, class_id_b string")
    for block in (7, 256):
        pairs = neardup.duplicate_pairs(members, links, block=block)
        assert pairs.count() == pairs.distinct().count() == 300 * 299 // 2 + 300
        assert pairs.filter("doc_id_a >= doc_id_b").isEmpty()


def test_one_class_of_many(spark):
    """Copies are one class whatever their number; groups need no pairs."""
    df = spark.range(20_000).selectExpr("cast(id as string) as doc_id", "'A' as stratum", "'the same words stand in every one of these records' as text")
    members, links = neardup.near_duplicates(df)
    groups = neardup.duplicate_groups(members, links)
    assert groups.select("group_id").distinct().count() == 1 and groups.count() == 20_000 and links.isEmpty()


def test_recall_is_reported_or_refused(spark, monkeypatch):
    df = spark.createDataFrame(corpus(3, 80), SCHEMA)
    found = neardup.near_duplicates(df, similarity="0.75")
    assert found.recall >= 0.9999 and found.runs >= 7
    monkeypatch.setattr(neardup, "_estimated_recall", lambda links: 0.5)
    with pytest.raises(neardup.RecallError):
        neardup.near_duplicates(df, similarity="0.75")
