"""Token statistics of a language model, from an interpolated bigram model in DataFrames.

p(v|u) = w c(u,v)/c(u) + (1-w) p0(v), with p0 the add-one unigram model over the corpus' vocabulary; a context that was
not seen has p = p0. The mean and variance of log p under the model are closed forms over each context's seen successors.
Any table of (doc_id, token_idx, logp, mu, var) can take this model's place.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.hashing import WordHasher, mix
from siftwell.runtime import Scratch

WEIGHT = 0.5


def token_lists(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, w: blank-separated tokens in lower case."""
    return df.select(F.col(id_col).alias("doc_id"), F.filter(F.split(F.lower(F.col(text_col)), r"[ \t\n\f\r]+"), lambda x: x != "").alias("w"))


def token_pairs(lists: DataFrame) -> DataFrame:
    """doc_id, token_idx, u, v (and fold): each token after the first with the one before it; no shuffle."""
    pairs = F.transform(F.sequence(F.lit(2), F.size("w")), lambda i: F.struct((i - 1).cast("int").alias("token_idx"), F.get("w", i - 2).alias("u"), F.get("w", i - 1).alias("v")))
    own = [c for c in ("doc_id", "fold") if c in lists.columns]
    return lists.filter(F.size("w") > 1).select(*own, F.explode(pairs).alias("p")).select(*own, "p.*")


@dataclass
class Bigrams:
    """Models by fold of the training documents, 0 where there is but one."""

    unigrams: DataFrame  # fold, v, p0
    seen: DataFrame  # fold, u, v, p
    contexts: DataFrame  # fold, u, mu, var
    floor: dict[int, tuple[float, float]]  # mu and var of p0


def _folded(lists: DataFrame) -> DataFrame:
    return lists if "fold" in lists.columns else lists.withColumn("fold", F.lit(0))


def _of_fold(values: dict[int, float]):
    return F.element_at(F.create_map(*(F.lit(x) for f, v in sorted(values.items()) for x in (int(f), float(v)))), F.col("fold").cast("int"))


def train(corpus: DataFrame, training: DataFrame, scratch: Scratch, weight: float = WEIGHT) -> Bigrams:
    """A model from token lists, or one for each `fold` of them, in one pass; the vocabulary is the corpus', the counts are
    the training documents'. Folds are few; their totals come to the driver."""
    training = _folded(training)
    words = corpus.select(F.explode("w").alias("v")).distinct()
    counts = scratch.keep(training.select("fold", F.explode("w").alias("v")).groupBy("fold", "v").agg(F.count(F.lit(1)).alias("c")), "counts")
    totals = {r.fold: r.n for r in counts.groupBy("fold").agg(F.sum("c").alias("n")).collect()} or {0: 0}
    each = words.select("v", F.explode(F.array(*(F.lit(int(f)) for f in sorted(totals)))).alias("fold"))
    vocabulary = scratch.keep(each.join(counts, ["fold", "v"], "left").select("fold", "v", F.coalesce("c", F.lit(0)).alias("c")), "vocabulary")
    sizes = {r.fold: totals[r.fold] + r.n for r in vocabulary.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()} or {0: 1}
    unigrams = vocabulary.select("fold", "v", ((F.col("c") + 1) / _of_fold(sizes)).alias("p0"))
    own = F.log("p0")
    floors = {r.fold: (r.s, r.q) for r in unigrams.groupBy("fold").agg(F.sum(F.col("p0") * own).alias("s"), F.sum(F.col("p0") * own * own).alias("q")).collect()} or {0: (0.0, 0.0)}
    s0, q0 = _of_fold({f: s for f, (s, _) in floors.items()}), _of_fold({f: q for f, (_, q) in floors.items()})
    pairs = scratch.keep(token_pairs(training).groupBy("fold", "u", "v").agg(F.count(F.lit(1)).alias("c")), "pairs")
    before = pairs.groupBy("fold", "u").agg(F.sum("c").alias("n"))
    rest = 1 - weight
    seen = scratch.keep(pairs.join(before, ["fold", "u"]).join(unigrams, ["fold", "v"]).select("fold", "u", "v", "p0", (F.lit(weight) * F.col("c") / F.col("n") + F.lit(rest) * F.col("p0")).alias("p")), "seen")
    lp = F.log("p")
    sums = seen.groupBy("fold", "u").agg(
        F.sum(F.col("p") * lp).alias("a"), F.sum(F.col("p") * lp * lp).alias("b"), F.sum(F.col("p0") * own).alias("s"), F.sum(F.col("p0") * own * own).alias("r"), F.sum("p0").alias("m")
    )
    k = F.log(F.lit(rest))
    mu = F.col("a") + F.lit(rest) * ((s0 - F.col("s")) + k * (1 - F.col("m")))
    second = F.col("b") + F.lit(rest) * ((q0 - F.col("r")) + 2 * k * (s0 - F.col("s")) + k * k * (1 - F.col("m")))
    contexts = scratch.keep(sums.select("fold", "u", mu.alias("mu"), (second - mu * mu).alias("var")), "contexts")
    return Bigrams(unigrams, seen.select("fold", "u", "v", "p"), contexts, {f: (s, q - s * s) for f, (s, q) in floors.items()})


def _keyed(rows: DataFrame) -> DataFrame:
    """With a number for the fold and both words, by which a join sorts faster than by the words; the words are compared as well."""
    return rows.withColumn("k", F.xxhash64("fold", "u", "v"))


def token_stats(lists: DataFrame, model: Bigrams) -> DataFrame:
    """doc_id, token_idx, logp, mu, var of the tokens of `lists`, whose words the model's vocabulary holds.

    `fold`, where lists have it, names the model that scores a document. The tables joined by one word have a row per word:
    Spark sends them to all tasks where they are small enough, and else splits the tokens of a frequent word over tasks.
    """
    rows = _keyed(token_pairs(_folded(lists))).join(_keyed(model.seen), ["k", "fold", "u", "v"], "left").join(model.unigrams, ["fold", "v"]).join(model.contexts, ["fold", "u"], "left")
    p = F.coalesce("p", F.when(F.col("mu").isNotNull(), F.lit(1 - WEIGHT) * F.col("p0")).otherwise(F.col("p0")))
    mu, var = (_of_fold({f: both[i] for f, both in model.floor.items()}) for i in (0, 1))
    return rows.select("doc_id", "token_idx", F.log(p).alias("logp"), F.coalesce("mu", mu).alias("mu"), F.greatest(F.coalesce("var", var), F.lit(0.0)).alias("var"))


def pair_stats(lists: DataFrame, model: Bigrams) -> DataFrame:
    """doc_id, token_idx, ce, xent: the bigram model observing, its unigram model performing."""
    s0 = _of_fold({f: mu for f, (mu, _) in model.floor.items()})
    logs = model.unigrams.select("fold", "v", "p0", F.log("p0").alias("l0"))
    per_context = model.seen.join(logs, ["fold", "v"]).groupBy("fold", "u").agg(F.sum(F.col("p") * F.col("l0")).alias("a"), F.sum(F.col("p0") * F.col("l0")).alias("s"))
    cross = per_context.select("fold", "u", (-(F.col("a") + F.lit(1 - WEIGHT) * (s0 - F.col("s")))).alias("xent"))
    rows = token_pairs(_folded(lists)).join(logs, ["fold", "v"]).join(cross, ["fold", "u"], "left")
    return rows.select("doc_id", "token_idx", (-F.col("l0")).alias("ce"), F.coalesce("xent", -s0).alias("xent"))


def _coded(batch):
    """(words, number of each token's word, of its document) of a batch of doc_id, fold and text in lower case, as token_lists has them."""
    import pyarrow.compute as pc

    lists = pc.split_pattern_regex(batch.column(2), r"[ \t\n\f\r]+")
    coded = lists.flatten().dictionary_encode()
    words, codes, docs = coded.dictionary.to_pylist(), coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy().astype(np.int64)
    if "" in words:
        docs, codes = docs[(own := codes != words.index(""))], codes[own]
    return words, codes, docs


def _word_counts(batches):
    """v, again, fold, c: two hashes of each word and how often a batch's documents of the fold have it."""
    import pyarrow as pa

    first, second = WordHasher(b"word"), WordHasher(b"again")
    for batch in batches:
        words, codes, docs = _coded(batch)
        v, again = (h(words).view(np.int64) for h in (first, second))
        folds = batch.column(1).to_numpy()[docs]
        for fold in np.unique(folds):
            c = np.bincount(codes[folds == fold], minlength=len(words))
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(v[at]), pa.array(again[at]), pa.array(np.full(len(at), fold, np.int32)), pa.array(c[at].astype(np.int64))], ["v", "again", "fold", "c"])


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays compressed, those of numbers not below 0 in as few bytes as the largest needs."""
    import pickle

    import pyarrow as pa

    raw = pickle.dumps([a.astype(np.min_scalar_type(int(a.max()))) if len(a) and a.min() >= 0 else a for a in arrays], protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def _unpacked(blob: bytes) -> list:
    import pickle

    import pyarrow as pa

    return pickle.loads(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))


def _postings(batches, words: np.ndarray, parts: int):
    """part, ids, blob: a batch's pairs of words, each with its documents and how often they have it, by part of the first word."""
    import pyarrow as pa

    hasher, size = WordHasher(b"word"), len(words)
    for batch in batches:
        own, codes, docs = _coded(batch)
        ids, folds, n = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.num_rows
        if size * size * n >= 1 << 63:
            raise ValueError(f"{size} words and {n} documents a batch do not fit one number")
        w = np.searchsorted(words, hasher(own).view(np.int64))[codes].astype(np.int64)
        follows = docs[1:] == docs[:-1]
        triples = ((w[:-1] * size + w[1:]) * n + docs[1:])[follows]
        triples.sort()
        at = np.flatnonzero(np.diff(triples, prepend=-1))
        times, pairs, docs = np.diff(at, append=len(triples)), triples[at] // n, triples[at] % n
        part = (mix((pairs // size).astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
        rows = []
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            starts = np.flatnonzero(np.diff(pairs[mine], prepend=-1))
            rows.append((int(k), _packed(np.diff(pairs[mine][starts], prepend=0), np.diff(starts, append=len(mine)), docs[mine], times[mine])))
        if rows:
            about = _packed(np.diff(ids, prepend=0), folds)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([about] * len(rows), pa.binary()), pa.array([b for _, b in rows], pa.binary())], ["part", "ids", "blob"])


def _sums(pdf, counts: np.ndarray, sizes: np.ndarray, floor: np.ndarray, references: list[int], weight: float):
    """doc_id, n and each reference's sums over the pairs of a part; all pairs of their first words are here, so the model of these is as well.

    counts: folds x words, how often the fold has the word; floor: s0 and q0 of each fold, as train() has them."""
    import pandas as pd

    folds, size = counts.shape

    def blocks():
        """ids, folds, pairs, documents of each pair, and these with their times: unpacked anew, so one block at a time is held."""
        for i, b in zip(pdf["ids"], pdf["blob"], strict=True):
            ids, own, keys, *rest_ = _unpacked(i) + _unpacked(b)
            yield np.cumsum(ids.astype(np.int64)), own.astype(np.int64), np.cumsum(keys.astype(np.int64)), *rest_

    pairs = np.unique(np.concatenate([keys for _, _, keys, *_ in blocks()]))
    c = np.zeros((folds, len(pairs)))
    for _, own, keys, runs, docs, times in blocks():
        local = own[docs] * len(keys) + np.repeat(np.arange(len(keys)), runs)
        c[:, np.searchsorted(pairs, keys)] += np.bincount(local, times, folds * len(keys)).reshape(folds, -1)
    starts = np.flatnonzero(np.diff(pairs // size, prepend=-1))
    context = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(pairs)))
    total, rest = lambda x: np.add.reduceat(x, starts), 1 - weight
    logp, mu, var = np.empty(c.shape), np.empty((folds, len(starts))), np.empty((folds, len(starts)))
    for f in range(folds):
        n, seen, p0, (s0, q0), k = total(c[f]), c[f] > 0, (counts[f, pairs % size] + 1) / sizes[f], floor[:, f], np.log(rest)
        known = n > 0
        p = np.where(seen, weight * c[f] / np.maximum(n, 1)[context] + rest * p0, np.where(known[context], rest * p0, p0))
        logp[f], l0 = np.log(p), np.log(p0)
        a, b, s, r, m = (total(np.where(seen, x, 0.0)) for x in (p * logp[f], p * logp[f] ** 2, p0 * l0, p0 * l0 * l0, p0))
        mean = a + rest * ((s0 - s) + k * (1 - m))
        spread = b + rest * ((q0 - r) + 2 * k * (s0 - s) + k * k * (1 - m)) - mean * mean
        mu[f], var[f] = np.where(known, mean, s0), np.maximum(np.where(known, spread, q0 - s0 * s0), 0.0)
    out = []
    for ids, own, keys, runs, docs, times in blocks():
        pair, docs, times = np.repeat(np.searchsorted(pairs, keys), runs), docs.astype(np.int64), times.astype(float)
        add = lambda x: np.bincount(docs, x, len(own))  # noqa: E731, B023
        columns = {"doc_id": ids, "n": add(times)}
        for ref in references:
            fold = ((own + ref) % folds)[docs]
            columns |= {f"logp{ref}": add(times * logp[fold, pair]), f"mu{ref}": add(times * mu[fold, context[pair]]), f"var{ref}": add(times * var[fold, context[pair]])}
        out.append(pd.DataFrame(columns)[columns["n"] > 0])
    return pd.concat(out)


TOKENS_A_PART = 16_000_000


def document_sums(df: DataFrame, folds: int, references: list[int], weight: float = WEIGHT) -> DataFrame:
    """doc_id, n and logp<k>, mu<k>, var<k>: the sums of token_stats over each document of `df` (doc_id, text), scored as reference k
    by the model of fold (doc_id + k) modulo `folds`; documents of two tokens or more for which all these folds have documents.

    Tokens move once, as compressed postings of word pairs by first word, and a part of them holds all that the model of its
    words needs, so no table has a row per token. The words with their counts per fold are known to the driver and all tasks.
    """
    fold = F.pmod("doc_id", F.lit(folds)).cast("int")
    rows = df.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("fold"), F.lower("text").alias("text"))
    own = rows.mapInArrow(_word_counts, "v long, again long, fold int, c long").groupBy("v", "again", "fold").agg(F.sum("c").alias("c")).toPandas()
    words = np.unique(own["v"].to_numpy(np.int64))
    if len(own.drop_duplicates(["v", "again"])) != len(words):
        raise ValueError("two words share a hash")
    counts = np.zeros((folds, len(words)))
    counts[own["fold"].to_numpy(int), np.searchsorted(words, own["v"].to_numpy(np.int64))] = own["c"]
    totals = counts.sum(1)
    sizes = np.maximum(totals + len(words), 1)
    p0 = (counts + 1) / sizes[:, None]
    floor = np.stack([(p0 * np.log(p0)).sum(1), (p0 * np.log(p0) ** 2).sum(1)])
    parts = int(max(2 * df.sparkSession.sparkContext.defaultParallelism, totals.sum() // TOKENS_A_PART))
    columns = ["n", *(f"{c}{k}" for k in references for c in ("logp", "mu", "var"))]
    there = [r for r in range(folds) if all(totals[(r + k) % folds] for k in references)]
    blobs = rows.mapInArrow(lambda batches: _postings(batches, words, parts), "part int, ids binary, blob binary")
    sums = blobs.groupBy("part").applyInPandas(lambda pdf: _sums(pdf, counts, sizes, floor, references, weight), "doc_id long, " + ", ".join(f"{c} double" for c in columns))
    return sums.filter(F.pmod("doc_id", F.lit(folds)).isin(there)).groupBy("doc_id").agg(*(F.sum(c).alias(c) for c in columns))
