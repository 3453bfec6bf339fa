"""Evaluation texts inside training documents, by a distributed positional inverted index.

The index holds the postings of every term of the documents and is built once, by document: a row is a block of consecutive
documents with, for each of its terms (as 64-bit numbers), the list of the term's positions in the block. Building it moves
no text, querying it moves no postings, and any number of test sets can be searched in one index. A test item is covered by
seeds, runs of consecutive terms so placed that any shared passage of the wanted length holds one whole seed. In each block
the list of a seed's rarest term there is adjusted by the term's offset and intersected with the lists of the others from
rare to common, by looking each adjusted position up in the block's positions; a seed with a term that the block lacks is
done at once. What remains is extended on both sides to the exact length of the shared run. Proximity matches use the same
lists: places where enough distinct terms of an item fall into a short window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.hashing import WordHasher
from siftwell.functions.text import words
from siftwell.runtime import Scratch

INDEX_SCHEMA = "block long, doc_ids array<string>, doc_starts array<int>, size int, terms binary, counts binary, gaps binary"
ITEM_SCHEMA = "item_id string, item_row long, start int, parts int, terms binary"
HIT_SCHEMA = "doc_id string, item_id string, doc_word int, item_word int, n_words int, block long, doc int, item_row long, parts int"
BLOCK_DOCS = 1000
BLOCK_WORDS = 1_000_000
# Bound of the test terms that are broadcast at once; longer items are cut into parts that overlap.
QUERY_WORDS = 2_000_000
# Bound of the adjusted positions looked at at once.
SLICE = 2_000_000
GAP = 64


def _rows(columns, schema: str, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [p.split()[0] for p in schema.split(", ")])


def _row_numbers():
    """Numbers that no other task gives."""
    from pyspark import TaskContext

    context = TaskContext.get()
    at = (context.partitionId() if context else 0) << 40
    while True:
        yield at
        at += 1


def _index_rows(batches):
    """Worker: (doc_id, text) batches to index rows."""
    kinds = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    hasher, numbers = WordHasher(), _row_numbers()
    ids, starts, parts, size = [], [], [], 0

    def flush():
        terms = np.concatenate(parts)
        order = np.argsort(terms, kind="stable")
        order = order[np.searchsorted(terms[order], 1) :]  # 0 stands between documents
        found, counts = np.unique(terms[order], return_counts=True)
        gaps = np.diff(order, prepend=0).astype("<i4")
        firsts = np.cumsum(counts) - counts
        gaps[firsts] = order[firsts]
        row = (next(numbers), ids, starts, size, found.astype("<i8").tobytes(), counts.astype("<i4").tobytes(), gaps.tobytes())
        return _rows([[c] for c in row], INDEX_SCHEMA, kinds)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = _terms(hasher, text)
            ids.append(doc), starts.append(size), parts.append(terms), parts.append(np.zeros(GAP, np.int64))
            size += len(terms) + GAP
            if len(ids) >= BLOCK_DOCS or size >= BLOCK_WORDS:
                yield flush()
                ids, starts, parts, size = [], [], [], 0
    if ids:
        yield flush()


def _terms(hasher: WordHasher, text: str | None) -> np.ndarray:
    """A text's words as positive 63-bit numbers."""
    return ((hasher(words(text)) >> np.uint64(1)) | np.uint64(1)).astype(np.int64)


def _item_rows(most: int, overlap: int):
    """Worker: (item_id, text) batches to items as terms, in parts of at most `most` terms that overlap."""

    def run(batches):
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        hasher, numbers = WordHasher(), _row_numbers()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                terms = _terms(hasher, text)
                cuts = range(0, max(1, len(terms) - overlap), most - overlap)
                number = next(numbers)
                rows += [(item, number, at, len(cuts), terms[at : at + most].astype("<i8").tobytes()) for at in cuts]
            yield _rows([*zip(*rows, strict=True)] or [[]] * 5, ITEM_SCHEMA, kinds)

    return run


class Query:
    """A bounded set of test items as terms, with their seeds."""

    def __init__(self, items: list[tuple], length: int):
        self.items, self.length = [i[:4] for i in items], length
        starts, parts, size = [], [], 0
        for *_, terms in items:
            starts.append(size)
            parts += [terms, np.full(GAP, -1, np.int64)]
            size += len(terms) + GAP
        self.terms = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.starts = np.array(starts, np.int64)
        self.ends = self.starts + [len(i[4]) for i in items]
        self.width = length // 2 if length > 1 else 1
        step = length - self.width + 1
        self.seeds = np.array([s + k for s, (*_, t) in zip(starts, items, strict=True) if len(t) >= length for k in range(0, len(t) - self.width + 1, step)], np.int64)
        self.grid = self.terms[self.seeds[:, None] + np.arange(self.width)] if len(self.seeds) else np.zeros((0, self.width), np.int64)
        self.frequency: dict[int, int] = {}


class Postings:
    """A block's position lists, and its terms by position."""

    def __init__(self, row):
        self.terms, self.counts = np.frombuffer(row["terms"], "<i8"), np.frombuffer(row["counts"], "<i4").astype(np.int64)
        gaps = np.frombuffer(row["gaps"], "<i4").astype(np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        places = np.cumsum(gaps)
        before = np.concatenate([[0], places])[self.firsts]
        self.places = places - np.repeat(before, self.counts)
        self.forward = np.zeros(row["size"], np.int64)
        self.forward[self.places] = np.repeat(self.terms, self.counts)

    def number(self, terms: np.ndarray) -> np.ndarray:
        """Where terms stand in the block's list of terms, or -1."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return np.where(self.terms[at] == terms, at, -1) if len(self.terms) else np.full(terms.shape, -1)

    def list(self, number: int) -> np.ndarray:
        return self.places[self.firsts[number] : self.firsts[number] + self.counts[number]]


def phrase_hits(block: Postings, query: Query) -> list[tuple[int, int, int]]:
    """(place in block, place in query, length) of every shared run of at least the wanted length, each once."""
    known = block.number(query.grid)
    whole = np.flatnonzero((known >= 0).all(axis=1))
    if not len(whole):
        return []
    known = known[whole]
    order = np.argsort(block.counts[known], axis=1, kind="stable")
    rarest = known[np.arange(len(whole)), order[:, 0]]
    ends = np.cumsum(block.counts[rarest])
    hits: set[tuple[int, int, int]] = set()
    low = 0
    while low < len(whole):
        # As many seeds as have a bounded number of adjusted positions, one at least.
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + SLICE, "right")))
        sizes = block.counts[rarest[low:high]]
        seed = np.repeat(np.arange(low, high), sizes)
        place = block.places[np.repeat(block.firsts[rarest[low:high]], sizes) + np.arange(len(seed)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] - order[seed, 0]
        fits = (place >= 0) & (place + query.width <= len(block.forward))
        seed, place = seed[fits], place[fits]
        for k in range(1, query.width):
            offset = order[seed, k]
            same = block.forward[place + offset] == query.grid[whole[seed], offset]
            seed, place = seed[same], place[same]
        for q, p in zip(query.seeds[whole[seed]].tolist(), place.tolist(), strict=True):
            hits.add(_extended(block.forward, query, p, q))
        low = high
    return sorted(h for h in hits if h[2] >= query.length)


def _extended(forward: np.ndarray, query: Query, p: int, q: int) -> tuple[int, int, int]:
    """The whole shared run around a seed."""
    a = 0
    while p - a > 0 and q - a > 0 and forward[p - a - 1] == query.terms[q - a - 1]:
        a += 1
    b = query.width
    while p + b < len(forward) and q + b < len(query.terms) and forward[p + b] == query.terms[q + b]:
        b += 1
    return (p - a, q - a, a + b)


def near_hits(block: Postings, wanted: list[tuple[np.ndarray, int]], window: int) -> list[tuple[int, int, int]]:
    """(place in block, item, distinct terms) of every window that starts at a wanted term and holds enough of an item's."""
    out = []
    for item, (terms, least) in enumerate(wanted):
        present = block.number(terms)
        present = present[present >= 0]
        if len(present) < least:
            continue
        places = np.concatenate([block.list(n) for n in present])
        owner = np.repeat(np.arange(len(present)), block.counts[present])
        order = np.argsort(places, kind="stable")
        places, owner = places[order], owner[order]
        n = len(places)
        # A term counts in the windows that start after its last place before and reach it.
        last = np.full(n, -1)
        by_owner = np.lexsort((np.arange(n), owner))
        same = owner[by_owner[1:]] == owner[by_owner[:-1]]
        last[by_owner[1:][same]] = by_owner[:-1][same]
        first = np.maximum(last + 1, np.searchsorted(places, places - window, "right"))
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, np.arange(1, n + 1), -1)
        distinct = np.cumsum(change)[:n]
        out += [(int(places[k]), item, int(distinct[k])) for k in np.flatnonzero(distinct >= least)]
    return out


def _searched(shared, window: int | None, share: float):
    """Worker: index rows to hits, of phrases or, with a window, of proximity."""

    def run(batches):
        query = shared.value
        wanted = []
        if window is not None:
            for start, end in zip(query.starts.tolist(), query.ends.tolist(), strict=True):
                rare = np.unique(query.terms[start:end])
                often = np.array([query.frequency.get(t, 0) for t in rare.tolist()], np.int64)
                rare = rare[np.argsort(often, kind="stable")][: max(4, len(rare) // 2)]
                wanted.append((rare, max(4, int(np.ceil(share * len(rare))))))
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                block, starts, ids, out = Postings(row), np.array(row["doc_starts"]), row["doc_ids"], []
                if window is None:
                    for p, q, n in phrase_hits(block, query):
                        d, i = int(np.searchsorted(starts, p, "right")) - 1, int(np.searchsorted(query.starts, q, "right")) - 1
                        item, number, at, parts = query.items[i]
                        out.append((ids[d], item, p - int(starts[d]), q - int(query.starts[i]) + at, n, row["block"], d, number, parts))
                else:
                    best = {}
                    for p, i, n in near_hits(block, wanted, window):
                        d = int(np.searchsorted(starts, p, "right")) - 1
                        if n > best.get((d, i), (0, 0))[0]:
                            best[d, i] = (n, p)
                    out = [(ids[d], query.items[i][0], p - int(starts[d]), 0, n, row["block"], d, query.items[i][1], query.items[i][3]) for (d, i), (n, p) in best.items()]
                if out:
                    yield _rows([*zip(*out, strict=True)], HIT_SCHEMA, kinds)

    return run


def build_index(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The written index of documents, for search(). Null ids are left out; null and empty texts have no terms."""
    sources = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")
    return scratch.keep(sources.mapInArrow(_index_rows, INDEX_SCHEMA), "index")


def _queries(items: DataFrame, length: int):
    """Test items of a written table in queries of at most QUERY_WORDS terms (with the smallest part whole)."""
    held, size = [], 0
    for r in items.toLocalIterator():
        terms = np.frombuffer(r.terms, "<i8")
        if held and size + len(terms) > QUERY_WORDS:
            yield Query(held, length)
            held, size = [], 0
        held.append((r.item_id, r.item_row, r.start, r.parts, terms))
        size += len(terms)
    if held:
        yield Query(held, length)


def _joined(hits: DataFrame) -> DataFrame:
    """Runs found in parts of an item, with those that overlap on one diagonal as one."""
    own = ["block", "doc", "item_row", F.col("doc_word") - F.col("item_word")]
    before = Window.partitionBy(*own).orderBy("doc_word").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("doc_word") > F.coalesce(F.max(F.col("doc_word") + F.col("n_words")).over(before), F.lit(-1))).cast("int")
    cut = hits.withColumn("fresh", fresh).withColumn("diagonal", own[3])
    runs = cut.withColumn("run", F.sum("fresh").over(Window.partitionBy("block", "doc", "item_row", "diagonal").orderBy("doc_word")))
    end = F.max(F.col("doc_word") + F.col("n_words"))
    return runs.groupBy("doc_id", "item_id", "block", "doc", "item_row", "diagonal", "run").agg(F.min("doc_word").alias("doc_word"), F.min("item_word").alias("item_word"), (end - F.min("doc_word")).cast("int").alias("n_words"))


def search(index: DataFrame, items: DataFrame, scratch: Scratch, *, words_in_row: int = 12, proximity_window: int | None = None, proximity_share: float = 0.6, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The hits of test items in an index of build_index(), as leaks() gives them; reads no documents."""
    spark = index.sparkSession
    tests = items.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")).filter("item_id is not null")
    overlap = words_in_row - 1
    tests = scratch.keep(tests.mapInArrow(_item_rows(max(QUERY_WORDS, 2 * words_in_row), overlap), ITEM_SCHEMA), "items")
    counts = None
    if proximity_window is not None:
        pairs = index.mapInArrow(_term_counts, "term long, n long")
        counts = scratch.keep(pairs.groupBy("term").agg(F.sum("n").alias("n")), "term-counts")
    found = None
    for query in _queries(tests, words_in_row):
        if counts is not None:
            own = spark.createDataFrame([(int(t),) for t in np.unique(query.terms[query.terms > 0])], "term long")
            # At most as many terms as the query has.
            query.frequency = {r.term: r.n for r in counts.join(own, "term", "left_semi").collect()}
        hits = scratch.keep(index.mapInArrow(_searched(spark.sparkContext.broadcast(query), proximity_window, proximity_share), HIT_SCHEMA), "hits")
        found = hits if found is None else found.unionByName(hits)
    names = ["doc_id", "item_id", "doc_word", "item_word", "n_words"]
    if found is None:
        return spark.createDataFrame([], HIT_SCHEMA).select(*names)
    if proximity_window is not None:
        best = found.groupBy("doc_id", "item_id", "block", "doc", "item_row").agg(F.max_by(F.struct("doc_word", "item_word", "n_words"), F.struct("n_words", -F.col("doc_word"))).alias("b"))
        return best.select("doc_id", "item_id", "b.*")
    return found.filter("parts = 1").select(*names).unionByName(_joined(found.filter("parts > 1")).select(*names))


def _term_counts(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["terms"], "<i8")), pa.array(np.frombuffer(row["counts"], "<i4").astype(np.int64))], ["term", "n"])


def leaks(
    docs: DataFrame, items: DataFrame, *, words_in_row: int = 12, proximity_window: int | None = None, proximity_share: float = 0.6,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, doc_word, item_word, n_words: every maximal run of at least `words_in_row` words in a row that a
    document shares with an item, by place (from 0) in each.

    With `proximity_window`, instead the best window of so many words in each document that holds at least the share
    `proximity_share` of the rarer half of an item's distinct words (four at least), with their number in n_words.
    Items shorter than `words_in_row` can share no such run. Ids come out as text. Null ids are left out, null and empty
    texts have no words, repeated rows give repeated hits for documents, items with one id are searched each, other
    columns are ignored, and empty tables give an empty result. The index is built once; items are turned into terms in
    tasks and searched in sets of at most QUERY_WORDS, each one pass over the index. An item above that is cut into parts
    (a proximity window is sought in each part).
    """
    scratch = Scratch(docs.sparkSession, "leakage")
    index = build_index(docs, scratch, id_col=id_col, text_col=text_col)
    return search(index, items, scratch, words_in_row=words_in_row, proximity_window=proximity_window, proximity_share=proximity_share, item_col=item_col, item_text_col=item_text_col)
