"""Windows of texts, turns of conversations, and sequences."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.config import MAX_TOKENS, MIN_TOKENS, SEED
from siftwell.operators.texts import split_sentences


def _length(text: str) -> int:
    return len(text.split())


def pack_windows(units: list[str], name: str, low: int = MIN_TOKENS, high: int = MAX_TOKENS, joiner: str = "\n\n", separator: int = 0, length=_length) -> list[str]:
    """Consecutive units packed into windows of low..high tokens.

    Each window has its own target length, drawn from the hash of `name` and the number of the draw, so windows spread
    over the range. A unit above `high` closes the window and is packed by its sentences; one without sentences is left
    out. What is still short at the end, or at such a unit, is left out too.
    """
    out: list[str] = []
    draws = 0

    def target() -> int:
        nonlocal draws
        draws += 1
        return low + int(hashlib.sha256(f"{name}:{draws}".encode()).hexdigest()[:8], 16) % (high - low + 1)

    def pack(parts: list[str], glue: str) -> None:
        held: list[str] = []
        size, goal = 0, target()

        def close(least: int) -> None:
            nonlocal held, size, goal
            if held and size >= least:
                out.append(glue.join(held))
            held, size, goal = [], 0, target()

        for part in filter(None, (p.strip() for p in parts)):
            own = length(part)
            cost = own + (separator if held else 0)
            if cost > high:
                close(low)
                inner = split_sentences(part)
                if len(inner) > 1:
                    pack(inner, " ")
                continue
            if held and size + cost > high:
                close(low)
                cost = own
            held.append(part)
            size += cost
            if size >= goal:
                close(0)
        close(low)

    pack(units, joiner)
    return out


def _windows(pattern_split, low, high, joiner, seed):
    def run(batches):
        import re

        cut = re.compile(pattern_split)
        for batch in batches:
            ids, numbers, texts, sizes = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, window in enumerate(pack_windows(cut.split(text or ""), f"{seed}:{doc}", low, high, joiner)):
                    ids.append(doc), numbers.append(k), texts.append(window), sizes.append(_length(window))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], ["doc_id", "window", "text", "n_tokens"])

    return run


def windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit_split: str = r"\n+", low: int = MIN_TOKENS, high: int = MAX_TOKENS, joiner: str = "\n\n", seed: int = SEED) -> DataFrame:
    """doc_id, window, text, n_tokens: the windows of each text; no shuffle, and null texts have none."""
    rows = df.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_windows(unit_split, low, high, joiner, seed), "doc_id string, window int, text string, n_tokens int")


def hash_order(*columns, seed: int = SEED):
    """A fixed pseudorandom order that any engine can repeat: the MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns)))


def take_windows(df: DataFrame, k: int, group: str = "doc_id", order: str = "window", seed: int = SEED) -> DataFrame:
    """At most k rows of each group, drawn by hash; `order` keeps their original order."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(hash_order(group, order, seed=seed)))
    return df.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def sessions(df: DataFrame, by: list[str], start: str, stop: str, gap, order: list[str] | None = None) -> DataFrame:
    """df with `session`: its number within `by`, a new one where start lies more than `gap` after the last stop."""
    ordered = Window.partitionBy(*by).orderBy(start, *(order or []))
    fresh = F.when(F.col(start) - F.lag(stop).over(ordered) > F.lit(gap), 1).otherwise(0)
    return df.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(ordered)).drop("_fresh")


def turns(words: DataFrame, gap: float = 1.5) -> DataFrame:
    """meeting, turn, speaker, start, text from words (meeting, speaker, start, stop, token, punctuation).

    A speaker's words form utterances, cut at pauses above `gap`; punctuation joins the word before it, and is left out
    at an utterance's start. Utterances are put in order of start, and neighbours of one speaker merge.
    """
    cut = sessions(words, ["meeting", "speaker"], "start", "stop", gap, ["stop", "token"])
    items = F.sort_array(F.collect_list(F.struct("start", "stop", "token", "punctuation")))
    said = cut.groupBy("meeting", "speaker", "session").agg(items.alias("w")).withColumn("start", F.col("w")[0].start)
    joined = F.aggregate("w", F.lit(""), lambda a, x: F.when(x.punctuation & (a != ""), F.concat(a, x.token)).when(x.punctuation, a).when(a == "", x.token).otherwise(F.concat(a, F.lit(" "), x.token)))
    said = said.select("meeting", "speaker", "start", joined.alias("text")).filter("text <> ''")
    return merge_turns(said, ["meeting"], ["start", "speaker"], "speaker")


def merge_turns(df: DataFrame, by: list[str], order: list[str], speaker: str) -> DataFrame:
    """Neighbouring rows of one speaker as one: by, turn, speaker, start (first `order` column), text."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    fresh = F.when(F.col(speaker).eqNullSafe(F.lag(speaker).over(ordered)) & (F.row_number().over(ordered) > 1), 0).otherwise(1)
    islands = df.withColumn("_fresh", fresh).withColumn("turn", F.sum("_fresh").over(ordered))
    items = F.sort_array(F.collect_list(F.struct(*order, F.col("text"))))
    return islands.groupBy(*by, "turn", speaker).agg(items.alias("_items")).select(*by, "turn", speaker, F.col("_items")[0][order[0]].alias("start"), F.array_join(F.col("_items.text"), " ").alias("text"))


def latest_version(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """The row of the greatest version of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.col(v).desc_nulls_last() for v in version)))
    return df.withColumn("_place", place).filter("_place = 1").drop("_place")


def sequences(df: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """by, first, values: each key's distinct (time, value) pairs in order of time."""
    pairs = df.select(by, F.col(at).alias("at"), F.col(value).alias("value")).distinct()
    return pairs.groupBy(by).agg(F.min("at").alias("first"), F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x.value).alias("values"))


def control_texts(raw: DataFrame) -> DataFrame:
    """doc_id, text, n_tokens: one window of each generated text (doc_id, text), cut as the human texts are, without markdown."""
    from siftwell.operators.texts import cleaned, without_markdown

    plain = cleaned(raw.withColumn("text", without_markdown(F.col("text")))).select(F.col("id").alias("doc_id"), F.col("value").alias("text"))
    return take_windows(windows(plain), 1).select("doc_id", "text", "n_tokens")
