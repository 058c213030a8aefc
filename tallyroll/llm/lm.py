"""Masked pseudo-likelihood: a bidirectional window network scores every word from both its sides.

The vocabulary is every word of the corpus with its count, a table in Spark that grows with the corpus. The
network works on classes of words: the most frequent words are a class each, all others fall into hashed
classes, and a word's probability is that of its class times the word's share of the class:
ln P(word | around) = ln P(class | around) + ln(count(word) / (count(class) + 1)). The one added occurrence is
kept back for words that the corpus does not hold; such a word counts as UNSEEN occurrences. The network adds
one learnt vector per neighbour and place, squashes the sum, and predicts the class in two steps, its group and
its place in the group, so probabilities are exact and cheap. Its biases start at the classes' shares, so it starts
as the unigram model of the classes and learns what neighbours add.

It is trained in numpy on all different texts: a hash of the text deals them to shards of about SHARD_WORDS words,
and a shard trains in the order of the hash, in steps of BATCH words, so the weights depend on the corpus alone
and not on how its rows are cut into files or tasks. In each round the round's shards start from the common
weights, and their weights, one array a shard, are averaged by their words as a tree. Copies of a text
that a task has met stay out before the shuffle, so a text that fills a third of the table is no large shard.
Texts are split twice, to count the words and to turn them into class ids; training and scoring read the stored ids.
What is gathered (word counts, weights per shard) grows with the corpus; what reaches the driver is one row
per class, at most TREE arrays, and one row per word with over KNOWN_SHARE of all words, so at most
1 / KNOWN_SHARE. The tasks hold the counts of those words, a join brings in the counts of all others; the result
is the same wherever the line is drawn. A document's score is the sum of ln P(word | two words on each side).

Null and empty texts have no words, score 0 and no mean. Texts are scored as a whole. Words of equal
frequency rank by their letters. Repeated rows get equal scores; an empty table gives an empty result.
Columns that carry a result's name give way to it.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tallyroll.llm.common import slices, stored

PLACES = (-2, -1, 1, 2)
GROUPS, MEMBERS, HIDDEN = 16, 32, 16
SIZE = GROUPS * MEMBERS
HASHED = 128
FREQUENT = SIZE - HASHED - 1  # id 0 stands beyond both ends of a text
BATCH = 8192
# A word with more than this share of all words has its count in every task.
KNOWN_SHARE = 2e-6
# Fixed value: how many occurrences a word counts as that the corpus does not hold.
UNSEEN = 0.5
# Distinct words that a task counts before it hands them on; text hashes that it remembers.
COUNTED, REMEMBERED = 200_000, 500_000
# Words whose hashed class a task remembers.
HASHED_KNOWN = 100_000
# Words of a shard, and arrays of weights that are added up at once.
SHARD_WORDS, TREE = 2_000_000, 64
SHAPES = {"context": (len(PLACES), SIZE, HIDDEN), "bias": (HIDDEN,), "group": (HIDDEN, GROUPS), "group_bias": (GROUPS,), "member": (GROUPS, HIDDEN, MEMBERS), "member_bias": (GROUPS, MEMBERS)}
LENGTH = sum(int(np.prod(s)) for s in SHAPES.values())


class Words(dict):
    """Ids of words; those that are not frequent are hashed when they come up, and some of them remembered."""

    def __missing__(self, word: str) -> int:
        found = 1 + FREQUENT + zlib.crc32(word.encode()) % HASHED
        if len(self) < HASHED_KNOWN:
            self[word] = found
        return found


class Places(dict):
    """Places of frequent and common words in a table; other words give minus their hashed class, some remembered."""

    def __init__(self, words: Sequence[str]):
        super().__init__(zip(words, range(1, len(words) + 1)))
        self.most = len(self) + HASHED_KNOWN

    def __missing__(self, word: str) -> int:
        found = -(1 + FREQUENT + zlib.crc32(word.encode()) % HASHED)
        if len(self) < self.most:
            self[word] = found
        return found


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Views of the weights in one flat array."""
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = flat[at : at + n].reshape(shape)
        at += n
    return out


def softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities down the columns, in place: sums along the long axis are several times as fast."""
    logits -= logits.max(axis=0)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=0)
    return logits


class Network:
    """The weights in single precision, with Adagrad's sums while training."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        self.w = split(self.flat)

    @staticmethod
    def fresh(seed: int = 5) -> np.ndarray:
        flat = np.random.default_rng(seed).normal(0, 0.1, LENGTH)
        for name in ("bias", "group_bias", "member_bias"):
            split(flat)[name][:] = 0
        return flat

    def forward(self, ids: np.ndarray, around: np.ndarray):
        """Of words sorted by group: hidden layer, group probabilities, and (words, probabilities) of the members of each group."""
        w = self.w
        h = w["context"][0].take(around[0], axis=0)
        h += w["bias"]
        for p in range(1, len(PLACES)):
            h += w["context"][p].take(around[p], axis=0)
        np.tanh(h, out=h)
        logits = w["group"].T @ h.T
        logits += w["group_bias"][:, None]
        cuts = np.searchsorted(ids, np.arange(GROUPS + 1) * MEMBERS)
        members = []
        for g in range(GROUPS):
            if cuts[g] < cuts[g + 1]:
                part = slice(cuts[g], cuts[g + 1])
                own = w["member"][g].T @ h[part].T
                own += w["member_bias"][g][:, None]
                members.append((g, part, softmax(own)))
        return h, softmax(logits), members

    @staticmethod
    def by_group(ids: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the words by class, and so by group, and ids and neighbours in that order."""
        order = np.argsort(ids.astype(np.int16), kind="stable")  # short numbers sort by radix
        return order, ids[order], around.take(order, axis=1)

    def log_probability(self, ids: np.ndarray, around: np.ndarray) -> np.ndarray:
        out = np.empty(len(ids), np.float64)
        for at in range(0, len(ids), BATCH):
            cut = slice(at, at + BATCH)
            order, own, near = self.by_group(ids[cut], around[:, cut])
            _, groups, members = self.forward(own, near)
            part = np.log(groups[own // MEMBERS, np.arange(len(own))].astype(np.float64))
            for _, rows, p in members:
                part[rows] += np.log(p[own[rows] % MEMBERS, np.arange(p.shape[1])].astype(np.float64))
            out[cut][order] = part
        return out

    def train(self, ids: np.ndarray, around: np.ndarray, rate: float, sums: np.ndarray) -> None:
        """One Adagrad step on a batch."""
        n = np.float32(len(ids))
        _, ids, around = self.by_group(ids, around)
        h, groups, members = self.forward(ids, around)
        flat = np.zeros(LENGTH, np.float32)
        grad = split(flat)
        groups[ids // MEMBERS, np.arange(len(ids))] -= 1
        groups /= n
        grad["group"][:], grad["group_bias"][:] = h.T @ groups.T, groups.sum(axis=1)
        back = self.w["group"] @ groups
        for g, rows, p in members:
            p[ids[rows] % MEMBERS, np.arange(p.shape[1])] -= 1
            p /= n
            grad["member"][g], grad["member_bias"][g] = h[rows].T @ p.T, p.sum(axis=1)
            back[:, rows] += self.w["member"][g] @ p
        h *= h
        np.subtract(1, h, out=h)
        back *= h.T
        grad["bias"][:] = back.sum(axis=1)
        columns = back.astype(np.float64)
        for p in range(len(PLACES)):
            for k in range(HIDDEN):
                grad["context"][p, :, k] = np.bincount(around[p], columns[k], SIZE)
        sums += flat * flat
        self.flat -= rate * flat / (np.sqrt(sums) + np.float32(1e-8))


def tokens(texts: Sequence[str | None]) -> list[list[str]]:
    return [(t or "").lower().split() for t in texts]


def windows(texts: Sequence[str | None], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words, ids at PLACES around each, and the number of words of each text."""
    return laid_out(tokens(texts), words)


def laid_out(found: Sequence[Sequence], words: Words | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``windows`` of texts that are words already, or ids if no ``words`` are given."""
    reach = max(PLACES)
    sizes = np.array([len(f) for f in found], np.int64)
    line = np.zeros(int(sizes.sum()) + reach * (len(found) + 1), np.int64)
    starts = np.cumsum(sizes + reach) - sizes
    for f, at in zip(found, starts):
        line[at : at + len(f)] = f if words is None else list(map(words.__getitem__, f))
    spot = np.arange(int(sizes.sum())) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    return line[spot], np.stack([line[spot + p] for p in PLACES]), sizes


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n) of every word of the corpus, the words as they are scored."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for part in slices(batches, 0, 1_000_000):
            for found in tokens(part.column(0).to_pylist()):
                counts.update(found)
            if len(counts) > COUNTED:
                yield out()
                counts.clear()
        yield out()

    parts = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(work, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text: str) -> list[str]:
    """The FREQUENT most frequent words of the corpus."""
    return most_frequent(word_counts(df, text))


def most_frequent(counts: DataFrame) -> list[str]:
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()]


def class_shares(counts: DataFrame, vocabulary: list[str]) -> tuple[dict[str, float], np.ndarray, np.ndarray, int]:
    """ln(count) of the common words outside the vocabulary; ln(count + 1) of every class, 0 where a class is one
    word; the biases of the classes' shares; and the number of all words."""
    crc = F.crc32(F.col("word").cast("binary"))
    own = F.col("word").isin(vocabulary)
    classes = counts.groupBy(F.pmod(crc, F.lit(HASHED)).alias("class")).agg(F.sum(F.when(~own, F.col("n")).otherwise(0)).alias("hashed"), F.sum("n").alias("n")).collect()
    totals, sizes = np.zeros(SIZE), np.zeros(SIZE)
    for r in classes:
        totals[1 + FREQUENT + r["class"]] = np.log1p(r["hashed"])
        sizes[1 + FREQUENT + r["class"]] = r["hashed"]
    place = dict(zip(vocabulary, range(1, FREQUENT + 1)))
    for r in counts.filter(own).collect():
        sizes[place[r["word"]]] = r["n"]
    every = sum(r["n"] for r in classes)
    common = counts.filter(F.col("n") > every * KNOWN_SHARE).filter(~own)
    return {r["word"]: float(np.log(r["n"])) for r in common.collect()}, totals, np.log(sizes + 1), every


def first_weights(sizes: np.ndarray) -> np.ndarray:
    """Weights that start as the unigram model, from ln(count + 1) of the classes."""
    flat = Network.fresh()
    w, by_group = split(flat), np.exp(sizes).reshape(GROUPS, MEMBERS)
    w["group_bias"][:] = np.log(by_group.sum(axis=1))
    w["member_bias"][:] = np.log(by_group)
    return flat


def coded(df: DataFrame, text: str, keep: Sequence[str], vocabulary: list[str], common: dict[str, float], totals: np.ndarray) -> DataFrame:
    """The rows in class ids, stored: the columns ``keep`` as _0, _1, ... and what training and scoring both read.

    That is ``_n`` (words), ``_log`` (sum of ln share of the class, rare words without their counts), ``_rare`` (words whose count is not
    at hand), ``_ids`` (16-bit class ids), ``_hash`` (of the text), ``_again`` (its task has met the text before) and ``_row``.
    """
    value = df[f"`{text}`"].cast("string")
    given = df.select(*[df[f"`{c}`"].alias(f"_{i}") for i, c in enumerate(keep)], F.xxhash64(value).alias("_hash"), value.alias("_coded"))
    added = [("_n", T.LongType()), ("_log", T.DoubleType()), ("_rare", T.ArrayType(T.StringType())), ("_ids", T.BinaryType()), ("_again", T.BooleanType())]
    schema = T.StructType([*given.schema.fields[:-1], *[T.StructField(n, t) for n, t in added]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, met = Places([*vocabulary, *common]), set()
        classes, shares = np.zeros(1 + len(vocabulary) + len(common), np.int16), np.zeros(1 + len(vocabulary) + len(common))
        classes[1 : FREQUENT + 1] = np.arange(1, FREQUENT + 1)[: len(vocabulary)]
        for place, (word, share) in enumerate(common.items(), 1 + len(vocabulary)):
            classes[place], shares[place] = 1 + FREQUENT + zlib.crc32(word.encode()) % HASHED, share
        for part in slices(batches, -1, 1_000_000):
            again = []
            for h in part.column(part.num_columns - 2).to_pylist():
                again.append(h in met)
                met.add(h)
            if len(met) > REMEMBERED:
                met.clear()
            found = tokens(part.columns[-1].to_pylist())
            sizes = np.array([len(f) for f in found], np.int64)
            flat_words = list(chain.from_iterable(found))
            at = np.fromiter(map(places.__getitem__, flat_words), np.int64, len(flat_words))
            rare, seen = np.flatnonzero(at < 0), np.maximum(at, 0)
            ids = np.where(at < 0, -at, classes[seen]).astype(np.int16)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            sums = np.diff(np.concatenate([[0.0], np.cumsum(shares[seen] - totals[ids])])[bounds])
            rest = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, bounds), pa.int32()), pa.array([flat_words[i] for i in rare], pa.string()))
            raw = ids.tobytes()
            binary = pa.array([raw[2 * b : 2 * e] for b, e in zip(bounds[:-1], bounds[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes), pa.array(sums), rest, binary, pa.array(again, pa.bool_())], names=schema.names)

    # Written once, so that a row keeps its number while the counts of its rare words come in.
    return stored(given.mapInArrow(work, schema).withColumn("_row", F.monotonically_increasing_id()), "coded")


def trained_shards(rows: DataFrame, start: np.ndarray, rate: float) -> DataFrame:
    """(shard, total, seen) of shards (shard, hash, ids): each one's weights times its words."""

    def train(found: list[np.ndarray]) -> tuple[bytes, float]:
        network, sums = Network(start), np.full(LENGTH, 1e-6, np.float32)
        ids, around, _ = laid_out(found, None)
        for at in range(0, len(ids), BATCH):
            network.train(ids[at : at + BATCH], around[:, at : at + BATCH], rate, sums)
        return (network.flat.astype(np.float64) * len(ids)).tobytes(), float(len(ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, found = None, None, []

        def out() -> pa.RecordBatch:
            total, seen = train(found)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([total], pa.binary()), pa.array([seen])], names=["shard", "total", "seen"])

        for batch in batches:
            for s, h, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    if found:
                        yield out()
                    shard, last, found = s, None, []
                if h != last and ids:
                    found.append(np.frombuffer(ids, np.int16))
                last = h
        if found:
            yield out()

    return rows.repartition("shard").sortWithinPartitions("shard", "hash").mapInArrow(work, "shard long, total binary, seen double")


def added_up(parts: DataFrame, n: int) -> tuple[np.ndarray, float] | None:
    """Sum of at most ``n`` shards' weights and words, TREE at a time in the order of the shards."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard")
        total = np.sum([np.frombuffer(x, np.float64) for x in frame["total"]], axis=0)
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0]) // TREE], "total": [total.tobytes()], "seen": [frame["seen"].sum()]})

    while n > TREE:
        parts = stored(parts.groupBy(F.floor(F.col("shard") / TREE).alias("branch")).applyInPandas(add, "shard long, total binary, seen double"), "branch")
        n = -(-n // TREE)
    rows = sorted(parts.collect())
    if not rows:
        return None
    return np.sum([np.frombuffer(r["total"], np.float64) for r in rows], axis=0), sum(r["seen"] for r in rows)


def trained(rows: DataFrame, rounds: int, rate: float, first: np.ndarray, every: int) -> np.ndarray:
    """Weights after ``rounds`` rounds from ``first`` on the coded rows of a corpus of ``every`` words; each text trains in one of them."""
    shards = -(-every // (SHARD_WORDS * rounds)) or 1
    texts = rows.filter("not _again and _n > 0").select(
        F.pmod("_hash", F.lit(rounds)).alias("round"), F.pmod(F.shiftrightunsigned("_hash", 8), F.lit(shards)).alias("shard"), F.col("_hash").alias("hash"), F.col("_ids").alias("ids")
    )
    flat = first
    for r in range(rounds):
        parts = stored(trained_shards(texts.filter(F.col("round") == r).drop("round"), flat, rate), "shards")
        if found := added_up(parts, shards):
            flat = found[0] / found[1]
    return flat


def counted(corpus: DataFrame, text: str) -> tuple[DataFrame, list[str], dict[str, float], np.ndarray, np.ndarray, int]:
    """Word counts, vocabulary, ln(count) of common words, ln(count + 1) of hashed classes, first weights, number of words."""
    counts = stored(word_counts(corpus, text), "words")
    vocabulary = most_frequent(counts)
    common, totals, sizes, every = class_shares(counts, vocabulary)
    return counts, vocabulary, common, totals, first_weights(sizes), every


def fitted(corpus: DataFrame, text: str, rounds: int = 2, rate: float = 0.1) -> tuple[DataFrame, list[str], dict[str, float], np.ndarray, np.ndarray, np.ndarray]:
    """Word counts, vocabulary, ln(count) of common words, ln(count + 1) of hashed classes, first and trained weights."""
    counts, vocabulary, common, totals, first, every = counted(corpus, text)
    rows = coded(corpus, text, [], vocabulary, common, totals)
    return counts, vocabulary, common, totals, first, trained(rows, rounds, rate, first, every)


def score(
    df: DataFrame, text: str = "text", keep: Sequence[str] | None = None, rounds: int = 2, rate: float = 0.1, corpus: DataFrame | None = None
) -> DataFrame:
    """The columns ``keep`` (default all) with ``n_tokens``, ``log_probability`` and ``mean_log_probability``.

    The model comes from the column ``text`` of ``corpus``, by default of the table itself.
    """
    results = ["n_tokens", "log_probability", "mean_log_probability"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in results]
    counts, vocabulary, common, totals, first, every = counted(df if corpus is None else corpus, text)
    rows = coded(df, text, keep, vocabulary, common, totals)
    flat = trained(rows if corpus is None else coded(corpus, text, [], vocabulary, common, totals), rounds, rate, first, every)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(flat)
        for part in slices(batches, 1, 400_000):
            ids, around, sizes = laid_out([np.frombuffer(x, np.int16) for x in part.column(1).to_pylist()], None)
            logs = np.concatenate([[0.0], np.cumsum(network.log_probability(ids, around))])
            sums = np.diff(logs[np.concatenate([[0], np.cumsum(sizes)])])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums)], names=["_row", "_more"])

    networks = stored(rows.select("_row", "_ids").mapInArrow(work, "_row long, _more double"), "scored")
    rare = rows.select("_row", F.explode("_rare").alias("word")).join(counts, "word", "left")
    logs = networks.unionAll(rare.select("_row", F.log(F.coalesce(F.col("n"), F.lit(UNSEEN)))))
    total = F.col("_log") + F.col("_more")
    return rows.drop("_rare", "_ids").join(logs.groupBy("_row").agg(F.sum("_more").alias("_more")), "_row").select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_n").alias("n_tokens"), total.alias("log_probability"), F.when(F.col("_n") > 0, total / F.col("_n")).alias("mean_log_probability"),
    )
