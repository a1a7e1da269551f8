"""Language-model scores from a probabilistic suffix tree over words.

A text is its lower-cased words and one end symbol.  The root of the tree is the
unigram distribution of the training words, discounted; what the discount
takes is the probability of the one symbol for words not seen in training, as
in the base score.  Contexts are up to ``depth`` preceding words of the text.
A context, and a next word under it, takes part if it makes up ``least`` of all
training tokens at least, the minimal probability of such trees.  That share
falls with the cube root of the tokens, N: the tree grows with the corpus, to
LEAST ** -1 * N ** (1 / 3) sequences of either kind for each length at most,
while the counts that a state needs grow too, so that what it says gets surer.
Sequences whose parts are rarer are never counted.  A context becomes a state if its next-symbol
distribution, over its frequent next words and one class of all others, differs
from that of its longest shorter state by more than ``penalty`` nats of
likelihood gain for each of them; no state that passes is left out.  A state's
distribution is its counts, less a discount that goes to the longest shorter
state.  Each word is scored from the longest suffix state of what stands
before it, and the probabilities of all symbols sum to one in every state.

Counts come from all training texts, those whose crc32(id as text) mod 5 is
not 1, and every word's count is exact: words of less than ``least`` are joined
by shuffle, to base and root alike.  Frequent sequences are tables in the
shared folder.  About MOST_SENT of them, 24 bytes each, reach the driver and are broadcast
at once, and the frequent words: of more, the tree is counted, built and used in as many rounds over
the texts, each with the contexts that end in some of the words.  A state's
shorter ones end in the same word, so each word is scored in one round.

Nulls: a null or empty text is the end symbol alone; a null id counts as a
training row.  Repeated rows train and are scored each.  Without training rows
every symbol is the unknown one, of probability one, and both scores are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import textvec as tv

U64 = np.uint64
#: The word key of the end token: no word hash takes part in it.
END_KEY = -1
#: The least share of all training tokens of a context or a next word under it, times the cube root of their number.
LEAST = 1e-4
#: Frequent sequences that one round takes, about.
MOST_SENT = 8_000_000
#: The bits of a sequence's key that are those of its last token.
LAST = U64(0xFF)
#: What the root takes from each word's count for words not seen.
ROOT_DISCOUNT = 0.5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def streams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all tokens, an end after each text, and the first token of each text (and one past the last)."""
    data, offsets = tv.buffers(text)
    starts, ends, first = tv.word_bounds(data, offsets)
    end = np.array([END_KEY], np.int64).view(U64)[0]
    words = tv.word_hashes(data, starts, ends, True)
    words[words == end] = 0
    n = len(first) - 1
    out = np.full(len(words) + n, end, U64)
    out[np.arange(len(words)) + tv.owners(first)] = words
    return out, first + np.arange(n + 1)


def joined(context: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """Keys of sequences, from those of the sequences without their last and without their first token."""
    return tv.mix(context * U64(0x9E3779B97F4A7C15) + suffix) & ~LAST | suffix & LAST


def sequences(keys: np.ndarray, first: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``length`` tokens: the key of the sequence at each place, and whether it lies in one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for n in range(1, length + 1):
        yield keys, text[: len(keys)] == text[n - 1 :]
        keys = joined(keys[:-1], keys[1:])


def found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Finder:
    """``found`` in one table for many keys: the leading bits, spread as keys are hashes, give the place to look at, and few steps are left."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bits = max(1, len(table).bit_length() + 1)
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(table, np.arange(1 << bits, dtype=U64) << self.shift).astype(np.int32)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.table):
            return found(self.table, keys)
        last = len(self.table) - 1
        at = np.minimum(self.first[keys >> self.shift], last)
        there = self.table[at]
        below = np.flatnonzero(there < keys)
        while len(below):
            below = below[at[below] < last]
            at[below] += 1
            there[below] = self.table[at[below]]
            below = below[there[below] < keys[below]]
        return at, there == keys


class Combiner:
    """Sums of counts by key (and what goes with the key), in bounded memory: flushed when more than ``most`` keys are held."""

    def __init__(self, most: int = 3_000_000):
        self.most, self.held, self.size = most, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[list[np.ndarray]]:
        """columns: key, others, counts."""
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size > self.most:
            merged = self.merged()
            if 3 * len(merged[0]) > 2 * self.most:
                yield merged
                self.held, self.size = [], 0
            else:
                self.held, self.size = [merged], len(merged[0])

    def merged(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.held, strict=True)]
        if not columns or not len(columns[0]):
            return columns
        order = np.argsort(columns[0], kind="stable")
        keys = columns[0][order]
        new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return [keys[new], *(c[order[new]] for c in columns[1:-1]), np.add.reduceat(columns[-1][order], new)]


def _blocks(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(columns[0]) if columns else 0, 200_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 200_000].view(np.int64)) for c in columns], names)


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of all tokens of rows (text), combined in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Combiner()
        for batch in batches:
            for low, high in tv.slices(batch[0], 2 << 20):
                for done in held.add(*np.unique(streams(batch[0].slice(low, high - low))[0], return_counts=True)):
                    yield from _blocks(done, ["key", "n"])
        yield from _blocks(held.merged(), ["key", "n"])

    return docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def sequence_counts(docs: DataFrame, frequent, length: int) -> DataFrame:
    """(context, suffix, n): counts of ``length`` + 1 tokens, as the sequences without the last and without the first, where both stand in their broadcast sorted table."""
    names = ["context", "suffix", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, suffixes = frequent.value
        before, after, held = Finder(contexts), None if suffixes is contexts else Finder(suffixes), Combiner()
        for batch in batches:
            for low, high in tv.slices(batch[0], 2 << 20):
                tokens, first = streams(batch[0].slice(low, high - low))
                own = list(sequences(tokens, first, length + 1))
                keys, (whole, inside) = own[-2][0], own[-1]
                known = before(keys)[1]
                then = known if after is None else after(keys)[1]
                at = np.flatnonzero(inside & known[:-1] & then[1:])
                key, index, n = np.unique(whole[at], return_index=True, return_counts=True)
                for done in held.add(key, keys[at[index]], keys[at[index] + 1], n):
                    yield from _blocks(done[1:], names)
        yield from _blocks(held.merged()[1:], names)

    return docs.mapInArrow(run, "context long, suffix long, n long").groupBy("context", "suffix").agg(F.sum("n").alias("n"))


@dataclass
class Level:
    """Contexts of one length: the states with the share that they leave to the shorter one, and the probability of their frequent next words, as log10."""

    states: np.ndarray
    left: np.ndarray
    entries: np.ndarray
    logs: np.ndarray


def tree_level(context: np.ndarray, suffix: np.ndarray, n: np.ndarray, totals: tuple[np.ndarray, np.ndarray], below: tuple[np.ndarray, np.ndarray], penalty: float, discount: float) -> tuple[Level, np.ndarray, np.ndarray]:
    """The states of one length, and (key, probability) of all sequences (context, suffix, n) from their longest state.

    totals: counts of contexts, below: probabilities of suffixes, both by sorted key.
    """
    order = np.argsort(context, kind="stable")
    context, suffix, n = context[order], suffix[order], n[order].astype(float)
    keys = joined(context, suffix)
    q = below[1][found(below[0], suffix)[0]]
    new = np.flatnonzero(np.r_[True, context[1:] != context[:-1]]) if len(context) else np.zeros(0, np.int64)
    own = np.cumsum(np.bincount(new, minlength=len(context))) - 1 if len(context) else new
    states = context[new]
    total = totals[1][found(totals[0], states)[0]].astype(float)
    add = lambda x: np.add.reduceat(x, new) if len(new) else np.zeros(0)
    kinds, rest, apart = add(np.ones(len(n))), total - add(n), np.maximum(1 - add(q), 1e-12)
    other = rest > 0
    gain = add(n * np.log(n / total[own] / q)) + np.where(other, rest * np.log(np.where(other, rest, 1) / total / apart), 0.0)
    state = gain > penalty * (kinds + other)
    left = np.where(state, (rest + discount * kinds) / total, 1.0)
    p = np.where(state[own], (n - discount) / total[own] + left[own] * q, q)
    put, by = state[own], np.argsort(keys)
    inner = by[put[by]]
    return Level(states[state], np.log10(left[state]), keys[inner], np.log10(p[inner])), keys[by], p[by]


def collected(rows: DataFrame) -> list[np.ndarray]:
    """The columns of frequent rows: keys and counts."""
    table = rows.toArrow()
    return [table[c].to_numpy().view(U64) if c != "n" else table[c].to_numpy() for c in rows.columns]


def by_key(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    return keys[order], n[order]


def rounds_of(sequences: int) -> int:
    return min(int(LAST) + 1, max(1, -(-sequences // MOST_SENT)))


def in_round(table: DataFrame, column: str, rounds: int, number: int) -> DataFrame:
    """The sequences of a round, told by the last token of one of their parts."""
    return table if rounds == 1 else table.where(F.col(column).bitwiseAND(int(LAST)) % rounds == number)


def ending(table: DataFrame, rounds: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the sequences of a table whose last token belongs to a round."""
    if "key" in table.columns:
        return by_key(*collected(in_round(table, "key", rounds, number)))
    context, suffix, n = collected(in_round(table, "suffix", rounds, number))
    return by_key(joined(context, suffix), n)


def frequent_sequences(docs: DataFrame, words: DataFrame, total: int, *, depth: int, least: float) -> tuple[list[DataFrame], list[int]]:
    """Tables of the frequent words (key, n) and of longer sequences (context, suffix, n), in the shared folder, and their sizes."""
    spark, limit = shared.session(docs), frequent_count(total, least)
    tables = [shared.written(words.where(F.col("n") >= limit), "sequences")]
    sizes = [tables[0].count()]
    for length in range(1, depth + 1):
        rounds, parts = rounds_of(sizes[-1]), []
        for number in range(rounds):
            contexts = suffixes = ending(tables[-1], rounds, number)[0]
            if rounds > 1 and length == 1:
                suffixes = ending(tables[0], 1, 0)[0]
            elif rounds > 1:
                context, suffix, _ = collected(in_round(tables[-1], "context", rounds, number))
                suffixes = np.sort(joined(context, suffix))
            sent = spark.sparkContext.broadcast((contexts, suffixes))
            parts.append(shared.written(sequence_counts(docs, sent, length).where(F.col("n") >= limit), "sequences"))
            sent.unpersist()
            shared.released(spark)
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        tables.append(table)
        sizes.append(table.count())
        if not sizes[-1]:
            break
    return tables, sizes


def learn(tables: list[DataFrame], total: int, rounds: int = 1, number: int = 0, *, penalty: float, discount: float) -> tuple[tuple[np.ndarray, np.ndarray], list[Level]]:
    """The frequent words (sorted keys, counts), and the levels of a round's part of the tree."""
    head = counts = ending(tables[0], 1, 0)
    below, levels = (head[0], (head[1] - ROOT_DISCOUNT) / (total + 1)), []
    for length, table in enumerate(tables[1:], 1):
        if length > 1 and rounds > 1:
            counts = ending(tables[length - 1], rounds, number)
        context, suffix, n = collected(in_round(table, "context", rounds, number))
        level, more, p = tree_level(context, suffix, n, counts, below, penalty, discount)
        levels.append(level)
        counts, below = by_key(joined(context, suffix), n), (more, p)
    return head, levels


def frequent_count(total: int, least: float) -> int:
    return max(2, int(np.ceil(total * least)))


@dataclass
class Model:
    """A tree, or a round's part of it, as workers use it: the frequent words and the levels, with what finds keys in them."""

    counts: np.ndarray
    levels: list[Level]
    words: Finder
    finders: list[tuple[Finder, Finder]]

    @classmethod
    def of(cls, head: tuple[np.ndarray, np.ndarray], levels: list[Level]) -> Model:
        return cls(head[1], levels, Finder(head[0]), [(Finder(x.states), Finder(x.entries)) for x in levels])


def token_logs(tokens: np.ndarray, first: np.ndarray, model: Model, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token log10 of its probability, without that of the root for rare words; whether it is a frequent word; and its count then."""
    at, common = model.words(tokens)
    counts = np.where(common, model.counts[at] if len(model.counts) else 0, 0)
    logs = np.where(common, np.log10(np.maximum(counts - ROOT_DISCOUNT, 1e-300)) - np.log10(total + 1), 0.0)
    own = list(sequences(tokens, first, len(model.levels) + 1))
    for length, (level, (states, entries)) in enumerate(zip(model.levels, model.finders, strict=True), 1):
        whole, inside = own[length]
        at = np.flatnonzero(inside)
        where, state = states(own[length - 1][0][at])
        at, where = at[state], where[state]
        entry, known = entries(whole[at])
        logs[at + length] = np.where(known, level.logs[entry] if len(level.logs) else 0.0, logs[at + length] + level.left[where] if len(where) else 0.0)
    return logs, common, counts


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = 3, least: float | None = None, penalty: float = 2.0, discount: float = 0.8) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text, learnt from the training rows."""
    spark = shared.session(docs)
    key = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(key).alias("held_out"))
    training = rows.where("not held_out").select("text")
    words = shared.written(word_counts(training), "words")
    total, distinct = (int(x) for x in words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())
    shared.released(spark)
    least = LEAST / max(total, 1) ** (1 / 3) if least is None else least
    tables, sizes = frequent_sequences(training, words, total, depth=depth, least=least)
    rounds = rounds_of(sum(sizes))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    if rounds > 1:
        rows = shared.written(rows, "numbered")
    names = ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "word", "times"]
    schema = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, word long, times long"

    def scored(number: int, model) -> DataFrame:
        """What a round adds to each text; the first also what does not depend on contexts."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = Model.of(*model.value)
            for batch in batches:
                for low, high in tv.slices(batch["text"], 2 << 20):
                    n = high - low
                    tokens, first = streams(batch["text"].slice(low, n))
                    logs, common, counts = token_logs(tokens, first, tree, total)
                    if rounds > 1:
                        own = np.append(U64(0), tokens[:-1] & LAST) % U64(rounds) == number
                        own[first[:-1]] = number == 0
                        logs[~own] = 0
                    text = np.repeat(np.arange(n), np.diff(first))
                    known = np.bincount(text[common], minlength=n) * (number == 0)
                    base = np.bincount(text[common], np.log10(counts[common] + 0.5), n).astype(float) * (number == 0)  # of nothing it gives integers
                    row = batch["row"].slice(low, n).to_numpy()
                    # A text's own row has a key of its own, so that these rows spread.
                    spread = tv.mix(row.astype(U64)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(row), batch["doc_id"].slice(low, n), batch["held_out"].slice(low, n), pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(np.bincount(text, logs, n)), pa.array(spread), pa.nulls(n, pa.int64())], names)
                    # The rare words go to the shuffle, once a text.
                    rare = np.flatnonzero(~common) if number == 0 else np.zeros(0, np.int64)
                    order = rare[np.lexsort((tokens[rare], text[rare]))]
                    if len(order):
                        new = np.flatnonzero(np.r_[True, (tokens[order][1:] != tokens[order][:-1]) | (text[order][1:] != text[order][:-1])])
                        times, one = np.diff(np.append(new, len(order))), order[new]
                        none = [pa.nulls(len(one), k) for k in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                        yield pa.RecordBatch.from_arrays([pa.array(row[text[one]]), *none, pa.array(tokens[one].view(np.int64)), pa.array(times)], names)

        return rows.mapInArrow(run, schema)

    flat = None
    for number in range(rounds):
        model = spark.sparkContext.broadcast(learn(tables, total, rounds, number, penalty=penalty, discount=discount))
        part = scored(number, model)
        if rounds > 1:
            part = shared.written(part, "scored")
            model.unpersist()
        flat = part if flat is None else flat.unionByName(part)
    rare = words.where(F.col("n") < frequent_count(total, least)).select(F.col("key").alias("word"), F.col("n").alias("c"))
    c, unseen = F.col("c"), ROOT_DISCOUNT * distinct + 1
    part = flat.join(rare, "word", "left").select(
        "row", "doc_id", "held_out", "n_tokens",
        F.coalesce("known", F.when(c.isNotNull(), F.col("times")), F.lit(0)).alias("known"),
        F.coalesce("base", F.col("times") * F.log10(F.coalesce(c, F.lit(0)) + 0.5)).alias("base"),
        F.coalesce("score", F.col("times") * F.log10(F.coalesce(c - ROOT_DISCOUNT, F.lit(unseen)) / F.lit(float(total + 1)))).alias("score"))
    out = part.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("logs"), F.sum("score").alias("score"))
    floor = float(np.log10(total + 0.5 * (distinct + 1)))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * floor).alias("base_score"), "score")


def op2_suffix_tree(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The scores of all documents."""
    return score(docs)
