import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siftwell.functions.text import TOKEN, tokens, words
from siftwell.llm import leakage, mixing, splitting


def brute_runs(doc, item, least):
    a, b, out = words(doc), words(item), set()
    for i in range(len(a)):
        for j in range(len(b)):
            if i and j and a[i - 1] == b[j - 1]:
                continue
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n >= least:
                out.add((i, j, n))
    return out


def leak_tables(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta eps zeta eta theta".split()) if rng.random() < 0.6 else f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 12, 13, 30, 60]))), "s") for i in range(12)]
    docs = []
    for d in range(60):
        text = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.6:
            source = items[rng.randrange(len(items))][1].split()
            a = rng.randrange(len(source))
            text[len(text) // 2 : len(text) // 2] = source[a : a + rng.randrange(8, 40)]
        docs.append((d, ", ".join(w.upper() if rng.random() < 0.2 else w for w in text), d))
    docs += [(900, None, 1), (901, "", 1), (None, items[3][1], 1), (902, items[4][1] + " filler" * 50_000, 1)]
    return docs, items


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = leak_tables(1)
    d = spark.createDataFrame(docs, "doc_id int, text string, item_id int")
    i = spark.createDataFrame(items, "item_id int, text string, doc_id string")
    want = {(str(a), str(b), *r) for a, text, _ in docs if a is not None and text and len(text) < 10_000 for b, item, _ in items for r in brute_runs(text, item, 12)}
    for limit in (500_000, 100):
        monkeypatch.setattr(leakage, "QUERY_WORDS", limit)
        got = {tuple(r) for r in leakage.leaks(d, i).collect()}
        assert {r for r in got if r[0] != "902"} == want
        assert ("902", "4", 0, 0, len(words(items[4][1]))) in got or len(words(items[4][1])) < 12
    assert leakage.leaks(d.limit(0), i).count() == 0
    assert leakage.leaks(d, i.limit(0)).count() == 0


def test_proximity(spark):
    item = "amber basin cedar delta ember fjord grove haven inlet joust kiosk lemon"
    mixed = item.split()
    random.Random(3).shuffle(mixed)
    docs = [("hit", "pad " * 30 + " ".join(mixed) + " pad" * 30), ("far", (" pad" * 40).join(mixed)), ("none", "pad " * 90)]
    out = leakage.leaks(spark.createDataFrame(docs, "doc_id string, text string"), spark.createDataFrame([("i", item)], "item_id string, text string"), proximity_window=20)
    assert [r.doc_id for r in out.collect()] == ["hit"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", "Two.", "# Head\n", "\n\n", "- item\n", " ", ", ", "<p>", "1. ", "é!", "\n", "\u00a0", "x;", ""]), max_size=120), st.integers(1, 20), st.integers(0, 25))
def test_pieces_hold_and_rebuild(parts, limit, overlap):
    text = "".join(parts)
    pieces = splitting.split_text(text, limit, overlap)
    total = len(tokens(text))
    assert "".join(text[fresh:end] for _, _, _, fresh, end in pieces) == text
    assert pieces[0][0] == 0 and pieces[-1][1] == total
    shared = min(overlap, limit - 1)
    for k, (first, end, char, fresh, last) in enumerate(pieces):
        assert total == 0 or 0 < end - first <= limit
        assert tokens(text[char:last]) == tokens(text)[first:end]
        if k:
            assert pieces[k - 1][1] - first == min(shared, pieces[k - 1][1])


def test_cuts_at_structure():
    section = "# Part {}\n\n" + "Some words stand here. " * 4 + "\n\n"
    text = "".join(section.format(i) for i in range(6))
    size = len(tokens(section))
    for first, _, char, fresh, _ in splitting.split_text(text, 2 * size + 3, 0):
        assert text[fresh:].startswith("# Part")


def test_split_operator(spark):
    docs = [(1, "w " * 50, "a", 1), (2, "w " * 10, "a", 1), (3, None, "a", 1), (4, "", "a", 1), (5, "w " * 50, None, 1), (6, "w " * 50, "zzz", 1), (7, "longword" * 1000, "a", 1), (8, "w " * 50, "b", 1), (None, "w " * 50, "a", 1)]
    limits = [("a", 20, 4), ("a", 30, 4), ("b", None, 4), (None, 5, 1)]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string, max_tokens int")
    out = splitting.split_oversized(df, spark.createDataFrame(limits, "source string, max_tokens int, overlap_tokens int"))
    assert Counter(r.doc_id for r in out.collect()) == {"1": 3, None: 3} or Counter(r.doc_id for r in out.collect()) == {"1": 4, None: 4}
    assert out.filter("n_tokens > 20").count() == 0
    assert splitting.split_oversized(df.limit(0), spark.createDataFrame(limits, "source string, max_tokens int, overlap_tokens int")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutation(size, key):
    n = np.full(size, size, np.int64)
    out = mixing.permuted(np.arange(size), n, np.full(size, key, np.uint64))
    assert sorted(out.tolist()) == list(range(size))


def test_shard_counts_come_out():
    quota = {"a": 1000, "b": 3, "c": 0, "d": 500}
    shards = mixing.shard_counts(quota, 64, 1)
    assert Counter({s: sum(c.get(s, 0) for c in shards) for s in quota}) == Counter(quota)
    assert all(sum(c.values()) == 64 for c in shards[:-1])
    assert mixing.slot_quotas({"a": Fraction(1, 2), "b": Fraction(1, 2)}, {"a": 2, "b": 100}, 11) == {"a": 2, "b": 5}


def test_mixture(spark):
    rng = random.Random(5)
    docs = [(f"d{i}", " ".join("t" for _ in range(rng.randrange(0, 90))), rng.choice(["hot", "hot", "hot", "b", "c", "other"]), 1.0) for i in range(500)]
    docs += [("n", None, "b", 1.0), (None, "t t t", "b", 1.0), ("null", "t t", None, 1.0), ("d1", docs[1][1], docs[1][2], 1.0)]
    df = spark.createDataFrame(docs, "doc_id string, text string, source string, weight double")
    targets = spark.createDataFrame([("hot", 0.25, 1), ("b", 0.5, 2), ("c", 0.25, 3), ("gone", 0.0, 1)], "source string, weight double, max_repeats int")
    manifest, report = mixing.mixture(df, targets, block_tokens=16, shard_slots=50)
    rows = manifest.collect()
    counts = defaultdict(Counter)
    for r in rows:
        assert r.n_tokens == sum(s.to_token - s.from_token for s in r.segments) <= 16
        for s in r.segments:
            counts[s.doc_id].update(range(s.from_token, s.to_token))
    repeats = {"hot": 1, "b": 2, "c": 3}
    source = {d: s for d, _, s, _ in docs}
    for d, used in counts.items():
        assert max(used.values()) <= repeats[source[d]] * (2 if d == "d1" else 1)
        assert max(used) < len(TOKEN.findall(next(t for i, t, _, _ in docs if i == d)))
    total = sum(len(TOKEN.findall(t or "")) for _, t, _, _ in docs)
    lines = {r.source: r for r in report.collect()}
    own = Counter()
    for d, t, s, _ in docs:
        own[s] += len(TOKEN.findall(t or "")) if d else 0
    for s, w, m in (("hot", 0.25, 1), ("b", 0.5, 2), ("c", 0.25, 3)):
        assert lines[s].short == (m * own[s] < w * total)
        assert lines[s].tokens == own[s]
        if not lines[s].short:
            assert abs(lines[s].reached / total - w) < 0.02
        else:
            assert lines[s].reached == m * own[s]
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert len({(r.source, r.block, r.use) for r in rows}) == len(rows)
    empty, lines = mixing.mixture(df.limit(0), targets)
    assert empty.count() == 0 and lines.count() == 4
    assert mixing.mixture(df, targets.limit(0))[0].count() == 0


def test_shards_are_the_same_however_they_are_cut():
    quota = np.array([5_000_000_000, 3, 70_000, 900_000_000_000], np.int64)
    few = list(mixing.shards_between(quota, 1_000_000_000, 3, 0, 906))
    assert len(few) == 906 and sum(c for _, c, _ in few).tolist() == quota.tolist()
    for first in (0, 400, 905):
        for shard, counts, before in mixing.shards_between(quota, 1_000_000_000, 3, first, first + 1):
            assert counts.tolist() == few[shard][1].tolist() and before.tolist() == few[shard][2].tolist() == sum((c for k, c, _ in few[:shard]), 0 * quota).tolist()


def test_mixture_is_the_same_at_every_task_size(spark, monkeypatch):
    df = spark.createDataFrame([(f"d{i}", "t " * (i % 50), "hot" if i % 3 else "b") for i in range(300)], "doc_id string, text string, source string")
    targets = spark.createDataFrame([("hot", 0.5, 2), ("b", 0.5, 2)], "source string, weight double, max_repeats int")
    rows = []
    for size in (1, 256):
        monkeypatch.setattr(mixing, "SHARDS_A_TASK", size)
        rows.append(sorted(map(repr, mixing.mixture(df, targets, block_tokens=16, shard_slots=10)[0].collect())))
    assert rows[0] == rows[1]


def test_leaks_in_parts_of_items_and_slices_of_seeds(spark, monkeypatch):
    docs, items = leak_tables(2)
    docs = [d for d in docs if d[0] != 902] + [(950, items[0][1] + " x " + items[1][1], 0), (951, " ".join(i[1] for i in items), 0)]
    d, i = spark.createDataFrame(docs, "doc_id int, text string, item_id int"), spark.createDataFrame(items, "item_id int, text string, doc_id string")
    want = sorted((str(a), str(b), *r) for a, text, _ in docs if a is not None and text for b, item, _ in items for r in brute_runs(text, item, 12))
    for most, slice_ in ((25, 2_000_000), (2_000_000, 7)):
        monkeypatch.setattr(leakage, "QUERY_WORDS", most)
        monkeypatch.setattr(leakage, "SLICE", slice_)
        assert sorted(tuple(r) for r in leakage.leaks(d, i).collect()) == want


def test_one_index_serves_several_sets(spark):
    from siftwell.runtime import Scratch

    docs, items = leak_tables(3)
    scratch = Scratch(spark, "several")
    index = leakage.build_index(spark.createDataFrame(docs, "doc_id int, text string, item_id int"), scratch)
    i = spark.createDataFrame(items, "item_id int, text string, doc_id string")
    parts = [leakage.search(index, i.filter(f"item_id % 2 = {k}"), scratch) for k in (0, 1)]
    whole = leakage.search(index, i, scratch)
    assert sorted(map(tuple, parts[0].unionByName(parts[1]).collect())) == sorted(map(tuple, whole.collect()))
    assert "TextScan" not in whole._jdf.queryExecution().toString() and "Python" not in whole._jdf.queryExecution().toString()


def test_few_words_take_bounded_memory():
    """A block and a query of sixty words only: adjusted positions are looked at in slices."""
    import tracemalloc

    rng = np.random.default_rng(1)
    vocabulary = np.sort(rng.integers(1, 2**62, 60))
    text = vocabulary[rng.integers(0, 60, 100_000)]
    order = np.argsort(text, kind="stable")
    _, counts = np.unique(text, return_counts=True)
    gaps = np.diff(order, prepend=0)
    firsts = np.cumsum(counts) - counts
    gaps[firsts] = order[firsts]
    block = leakage.Postings({"terms": vocabulary.astype("<i8").tobytes(), "counts": counts.astype("<i4").tobytes(), "gaps": gaps.astype("<i4").tobytes(), "size": len(text)})
    assert (block.forward == text).all()
    query = leakage.Query([("i", 0, 0, 1, np.concatenate([vocabulary[rng.integers(0, 60, 40_000)], text[500:540]]))], 12)
    tracemalloc.start()
    hits = leakage.phrase_hits(block, query)
    assert tracemalloc.get_traced_memory()[1] < 400_000_000
    tracemalloc.stop()
    assert any(p <= 500 and p + n >= 540 for p, _, n in hits)


def pieces_of(text, limit):
    return [text[fresh:end] for _, _, _, fresh, end in splitting.split_text(text, limit, 0)]


def test_headings_stay_with_what_they_head():
    body = "Some words stand here in a row. " * 9
    text = "".join(f"# {name}\n\n{body}\n\n" for name in "ABC")
    pieces = pieces_of(text, 60)
    assert [p.split("\n")[0] for p in pieces if "#" in p] == ["# A", "# B", "# C"]
    assert all(p.startswith("#") or "#" not in p for p in pieces)
    assert all(len(tokens(p)) > 3 for p in pieces if p.startswith("#"))


def test_fences_tables_and_lists_are_nodes():
    prose = "Words stand here in a row and more follow. " * 3
    fence = "```\na = 1\n\nb = 2\n\nc = 3\n```\n"
    table = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\n"
    items = "- one thing\n  - under it\n  - more of it\n- another thing\n"
    for block in (fence, table, items):
        text = f"{prose}\n\n{block}\n{prose}\n\n{block}\n{prose}\n"
        pieces = pieces_of(text, 45)
        assert sum(block in p for p in pieces) == 2, pieces


def test_only_whole_siblings_merge():
    long, short = "One sentence stands here. " * 12, "A short one."
    pieces = pieces_of(f"{short}\n\n{long}\n\n{short}\n", 30)
    assert pieces[0].strip() == short and pieces[-1].strip() == short


def test_markup_and_wrapped_lines():
    html = "<div><h2>Head</h2><p>" + "Words stand here. " * 8 + "</p><p>" + "More words stand. " * 8 + "</p></div><div><h2>Next</h2><p>" + "Last words stand. " * 8 + "</p></div>"
    pieces = pieces_of(html, 60)
    # "><" is one token, so a cut between elements falls behind its "<".
    assert all(p.lstrip("<").startswith(("div><h2>", "p>")) for p in pieces)
    wrapped = "These words are wrapped at\nsome width and the sentence\ngoes on. Another one starts\nhere and ends too. " * 4
    assert all(p.rstrip().endswith(".") for p in pieces_of(wrapped, 30))
    assert "".join(pieces_of("<div>" * 500 + "word " * 50 + "</div>" * 500, 10)) == "<div>" * 500 + "word " * 50 + "</div>" * 500
