"""Language-model scores by prediction by partial matching, beside a unigram base score.

The model is a byte-context trie of order ``ORDER``: counts of every context and its next
symbol, gathered from the training documents. A symbol is coded in the longest context that
was seen. If it is new there, an escape is coded (method C: as many chances as the context
has distinct symbols) and the next shorter context follows, without the symbols that the
longer one has: they are excluded, as they would have been coded there. Below the empty
context all symbols left are equally likely. As the model does not change while it scores,
every escape and every exclusion is a number of its trie node, and a document's code length
is a sum of table look-ups.

The trie holds all grams of the training documents. If the longest order has up to ``ENTRIES``
distinct ones, the whole trie is sent to the tasks. A larger trie is written: the totals,
distinct counts and exclusions of every context are counted over all of its entries, and per
order the most frequent contexts, each with all of its entries, are sent (``ENTRIES`` entries
at most). Places that the sent part cannot tell are looked up in the written trie by joins. So
are words of the base score: the ``TOP_WORDS`` most frequent are looked up in the task, all
others in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import fold, kept
from pairwell.llm.words import hashed_words, mix, text_bytes

ORDER = 4
BITS = 9
END, START = 256, 257
SYMBOLS = 257
ENTRIES = 1 << 19
TOP_WORDS = 1 << 17
BLOCK = 1 << 20
#: Distinct entries that a gathering task holds before it passes them on.
HELD = 1 << 21
#: Fixed value: the base score's addition to every count.
ADDED = 0.1


# --- symbols ------------------------------------------------------------------------------


def gram_keys(symbols: np.ndarray) -> np.ndarray:
    """Key of each place: ``ORDER`` symbols before it and the symbol itself, the last in the low bits."""
    key = np.zeros(len(symbols) - ORDER, np.int64)
    for k in range(ORDER + 1):
        key = (key << BITS) | symbols[k : len(symbols) - ORDER + k]
    return key


def blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, row of each key) of all bytes and ends of the texts; a long text comes in several blocks."""
    data, offsets = text_bytes(texts)
    row, rows = 0, len(texts)
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
        last = min(max(last, row + 1), rows)
        if offsets[last] - offsets[row] > 2 * BLOCK:
            yield from long_text(data[offsets[row] : offsets[last]], row)
        else:
            lengths = np.diff(offsets[row : last + 1])
            owner = np.repeat(np.arange(last - row), lengths)
            symbols = np.full(int(lengths.sum()) + (last - row) * (ORDER + 1), START, np.int64)
            symbols[np.arange(len(owner)) + owner * (ORDER + 1) + ORDER] = data[offsets[row] : offsets[last]]
            ends = np.cumsum(lengths + ORDER + 1) - 1
            symbols[ends] = END
            keys = gram_keys(symbols)
            scored = symbols[ORDER:] != START
            owners = np.repeat(np.arange(row, last), lengths + ORDER + 1)[ORDER:]
            yield keys[scored], owners[scored]
        row = last


def long_text(data: np.ndarray, row: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    before = np.full(ORDER, START, np.int64)
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK].astype(np.int64)
        tail = [np.array([END])] if at + BLOCK >= len(data) else []
        keys = gram_keys(np.concatenate([before, part, *tail]))
        yield keys, np.full(len(keys), row)
        before = np.concatenate([before, part])[-ORDER:]


# --- gathering ----------------------------------------------------------------------------


class Counter:
    """Counts of 64-bit keys, held until there are ``HELD`` distinct ones."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        new, counts = np.unique(keys, return_counts=True)
        both = np.concatenate([self.keys, new])
        self.keys, where = np.unique(both, return_inverse=True)
        self.counts = np.bincount(where, np.concatenate([self.counts, counts])).astype(np.int64)

    def flush(self, kind: int) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(self.keys), kind, np.int32)), pa.array(self.keys), pa.array(self.counts)],
            names=["kind", "key", "times"],
        )
        self.__init__()
        return out


WORD, GRAM = 0, 1


def gathered(texts: DataFrame) -> DataFrame:
    """(kind, key, times): counts of hashed words and of order-``ORDER`` grams over ``texts(text)``."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {WORD: Counter(), GRAM: Counter()}
        for batch in batches:
            for _, words, _ in hashed_words(batch.column(0)):
                counters[WORD].add(words.view(np.int64))
            for keys, _ in blocks(batch.column(0)):
                counters[GRAM].add(keys)
            for kind, counter in counters.items():
                if len(counter.keys) > HELD:
                    yield counter.flush(kind)
        for kind, counter in counters.items():
            yield counter.flush(kind)

    counts = texts.select("text").mapInArrow(gather, "kind int, key bigint, times bigint")
    return counts.groupBy("kind", "key").agg(F.sum("times").alias("times"))


def most(counts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` keys of highest count in ascending order of the key, and their counts."""
    table = counts.select("key", "times").orderBy(F.desc("times"), "key").limit(n).toArrow()
    keys, times = table["key"].to_numpy(), table["times"].to_numpy()
    order = np.argsort(keys)
    return keys[order], times[order]


# --- model --------------------------------------------------------------------------------


class Table:
    """Places of 64-bit keys by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(4 * max(len(keys), 1) - 1).bit_length())
        self.mask = (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        waiting, slot = np.arange(len(keys), dtype=np.int32), self.first(keys)
        while len(waiting):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = waiting[free]
            left = self.slots[slot] != waiting
            waiting, slot = waiting[left], (slot[left] + 1) & self.mask

    def first(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if it isn't there."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        slot = self.first(keys)
        found = self.slots[slot].astype(np.int64)
        wrong = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & self.mask
            found[wrong] = self.slots[slot[wrong]]
            at = found[wrong]
            wrong = wrong[(at >= 0) & (self.keys[at] != keys[wrong])]
        return found


@dataclass
class Level:
    """One order of the trie. Of entries: keys and log10 counts; of contexts: keys and node numbers.

    ``whole`` and ``escape``: log10 of the sum that counts are divided by, and of the escape, if
    coding begins here. ``whole_below`` and ``escape_below``: the same one order lower after an
    escape from here, with this context's symbols excluded. ``complete``: no context of this
    order is missing; a context that is here has all of its entries.
    """

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    whole: np.ndarray
    escape: np.ndarray
    whole_below: np.ndarray
    escape_below: np.ndarray
    complete: bool = True


def log10(x: np.ndarray) -> np.ndarray:
    return np.log10(np.where(x > 0, x, 1).astype(np.float64))


def trie(orders: list[tuple[np.ndarray, np.ndarray]]) -> list[Level]:
    """Levels from (keys, counts) per order, 0 first; an entry without its shorter one is left out."""
    levels: list[Level] = []
    shorter = None
    for order, (keys, counts) in enumerate(orders):
        if order:
            suffix = keys & ((1 << BITS * order) - 1)
            at = np.minimum(np.searchsorted(shorter[0], suffix), max(len(shorter[0]) - 1, 0))
            stays = shorter[0][at] == suffix if len(shorter[0]) else np.zeros(len(keys), bool)
            keys, counts, at = keys[stays], counts[stays], at[stays]
        contexts, starts = np.unique(keys >> BITS, return_index=True)
        total = np.add.reduceat(counts, starts) if len(keys) else counts
        distinct = np.diff(np.r_[starts, len(keys)])
        if order:
            excluded = np.add.reduceat(shorter[1][at], starts) if len(keys) else counts
            node = np.searchsorted(shorter[2], contexts & ((1 << BITS * (order - 1)) - 1))
            left, left_symbols = shorter[3][node] - excluded, shorter[4][node] - distinct
        else:
            left, left_symbols = np.zeros(len(contexts), np.int64), SYMBOLS - distinct
        below = log10(left + left_symbols)
        levels.append(
            Level(
                keys, log10(counts), contexts, log10(total + distinct), log10(distinct) - log10(total + distinct),
                below, np.where(left_symbols > 0, log10(left_symbols) - below, 0.0),
            )
        )
        shorter = (keys, counts, contexts, total, distinct)
    return levels


class Model:
    """Log10 probabilities from the levels of a trie."""

    def __init__(self, levels: list[Level]):
        self.levels = levels
        self.entries = [Table(x.keys) for x in levels]
        self.nodes = [Table(x.contexts) for x in levels]
        top = levels[-1]
        node = np.searchsorted(top.contexts, top.keys >> BITS)
        self.direct = top.counts - top.whole[node]

    def scores(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of each key's symbol after its context; NaN if contexts that aren't here decide it."""
        at = self.entries[-1].find(keys)
        out = np.where(at >= 0, self.direct[np.maximum(at, 0)] if len(self.direct) else 0.0, 0.0)
        rest = np.flatnonzero(at < 0)
        node = np.full(len(rest), -1, np.int64)  # the context one order higher that was escaped from
        for order in range(len(self.levels) - 1, -1, -1):
            level, key = self.levels[order], keys[rest] & ((1 << BITS * (order + 1)) - 1)
            entry, context = self.entries[order].find(key), self.nodes[order].find(key >> BITS)
            after = node >= 0
            if order + 1 < len(self.levels):
                above = self.levels[order + 1]
                whole = np.where(after, pick(above.whole_below, node), pick(level.whole, context))
                escape = np.where(after, pick(above.escape_below, node), pick(level.escape, context))
            else:
                whole, escape = pick(level.whole, context), pick(level.escape, context)
            found = entry >= 0
            out[rest] += np.where(found, pick(level.counts, entry) - whole, np.where(context >= 0, escape, 0.0))
            if not level.complete:
                out[rest[context < 0]] = np.nan
                found |= context < 0
            rest, node = rest[~found], context[~found]
        left = np.where(node >= 0, pick(self.levels[0].whole_below, node), np.log10(SYMBOLS))
        out[rest] -= left
        return out


def pick(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return values[np.maximum(at, 0)] if len(values) else np.zeros(len(at))


def lowest(symbols: int, key: str = "key") -> Column:
    """The last ``symbols`` symbols of a key."""
    return F.col(key).bitwiseAND(F.lit((1 << BITS * symbols) - 1))


def counted_orders(counts: DataFrame) -> list[DataFrame]:
    """(key, times) per order, 0 first; shorter orders are sums over the longer ones."""
    orders = [counts.filter(F.col("kind") == GRAM).select("key", "times")]
    for order in range(ORDER - 1, -1, -1):
        orders.append(orders[-1].groupBy(lowest(order + 1).alias("key")).agg(F.sum("times").alias("times")))
    return orders[::-1]


#: Per order: entries (key, times), and contexts with the numbers of their node.
Written = list[tuple[DataFrame, DataFrame]]


def written_trie(grams: list[DataFrame]) -> Written:
    """The whole trie as written tables. No key of its joins has more than ``SYMBOLS`` + 1 rows."""
    orders: Written = []
    for order, table in enumerate(grams):
        entries = kept(table, f"lm-entries-{order}") if order < ORDER else table
        rows = entries.withColumn("context", F.shiftright("key", BITS))
        node = [F.sum("times").alias("total"), F.count("*").alias("n_distinct")]
        if order:
            shorter, below = orders[-1]
            rows = rows.withColumn("suffix", lowest(order)).join(shorter.toDF("suffix", "shorter_times"), "suffix")
            contexts = rows.groupBy("context").agg(*node, F.sum("shorter_times").alias("excluded"))
            below = below.select(F.col("context").alias("suffix"), F.col("total").alias("t"), F.col("n_distinct").alias("d"))
            contexts = contexts.withColumn("suffix", lowest(order - 1, "context")).join(below, "suffix")
            left, left_symbols = F.col("t") - F.col("excluded"), F.col("d") - F.col("n_distinct")
        else:
            contexts = rows.groupBy("context").agg(*node)
            left, left_symbols = F.lit(0), F.lit(SYMBOLS) - F.col("n_distinct")
        whole = F.log10(F.col("total") + F.col("n_distinct"))
        whole_below = F.log10(F.greatest(left + left_symbols, F.lit(1)))
        contexts = contexts.select(
            "context", "total", "n_distinct",
            whole.alias("whole"),
            (F.log10("n_distinct") - whole).alias("escape"),
            whole_below.alias("whole_below"),
            F.when(left_symbols > 0, F.log10(left_symbols) - whole_below).otherwise(0.0).alias("escape_below"),
        )
        orders.append((entries, kept(contexts, f"lm-contexts-{order}")))
    return orders


def sent_level(entries: DataFrame, contexts: DataFrame) -> Level:
    """The contexts of highest total whose entries are ``ENTRIES`` together at most, with all of these."""
    top = contexts.orderBy(F.desc("total"), "context").limit(ENTRIES + 1).toArrow()
    n = int(np.searchsorted(np.cumsum(top["n_distinct"].to_numpy()), ENTRIES, side="right"))
    complete, top = n == len(top), top.slice(0, n)
    if n:
        total, context = top["total"][n - 1].as_py(), top["context"][n - 1].as_py()
        chosen = contexts.filter((F.col("total") > total) | ((F.col("total") == total) & (F.col("context") <= context)))
        entries = entries.withColumn("context", F.shiftright("key", BITS)).join(chosen, "context", "left_semi")
    table = entries.select("key", "times").limit(ENTRIES if n else 0).toArrow()
    by_key, by_context = np.argsort(table["key"].to_numpy()), np.argsort(top["context"].to_numpy())
    column = lambda name: top[name].to_numpy()[by_context]
    return Level(
        table["key"].to_numpy()[by_key], log10(table["times"].to_numpy()[by_key]), column("context"),
        column("whole"), column("escape"), column("whole_below"), column("escape_below"), complete,
    )


def learned(counts: DataFrame) -> tuple[list[Level], Written | None]:
    """What is sent of the trie, and the written trie if that is not all of it."""
    grams = counted_orders(counts)
    # Shorter orders have no more entries than the longest one.
    if grams[-1].count() <= ENTRIES:
        return trie([most(x, ENTRIES) for x in grams]), None
    written = written_trie(grams)
    return [sent_level(*order) for order in written], written


def looked_up_scores(asked: DataFrame, written: Written) -> DataFrame:
    """(key, score) of distinct keys by joins with the written trie, shortest order first.

    ``after``: what follows an escape from the key's own context. No key of a join has more than
    ``SYMBOLS`` + 1 rows.
    """
    known = None
    for order, (entries, contexts) in enumerate(written):
        rows = asked.select(lowest(order + 1).alias("key")).distinct().withColumn("context", F.shiftright("key", BITS))
        rows = rows.join(contexts, "context", "left").join(entries, "key", "left")
        if order:
            rows = rows.withColumn("suffix", lowest(order)).join(known, "suffix", "left")
            seen_below = F.log10("times_below") - F.col("whole_below")
            after = F.when(F.col("times_below").isNotNull(), seen_below).otherwise(F.col("escape_below") + F.col("after_below"))
            without = F.col("score_below")
        else:
            after, without = -F.col("whole_below"), F.lit(-float(np.log10(SYMBOLS)))
        begun = F.when(F.col("times").isNotNull(), F.log10("times") - F.col("whole")).otherwise(F.col("escape") + after)
        rows = rows.select("key", "times", after.alias("after"), F.when(F.col("total").isNull(), without).otherwise(begun).alias("score"))
        known = rows.toDF("suffix", "times_below", "after_below", "score_below")
    return rows.select("key", "score")


# --- scoring ------------------------------------------------------------------------------


def runs(keys: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each owner, how often each occurs, and how many each of ``size`` owners has."""
    order = np.lexsort((keys, owner))
    w, o = keys[order], owner[order]
    new = np.flatnonzero(np.r_[len(w) > 0, (w[1:] != w[:-1]) | (o[1:] != o[:-1])][: len(w)])
    return w[new], np.diff(np.r_[new, len(w)]).astype(np.int32), np.bincount(o[new], minlength=size)


def scored(docs: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    ``train`` chooses the rows to learn from. Tokens of the base score are the words, A-Z in
    lower case, and one end; ``score`` is the log10 probability of the text's bytes and its end.

    - A null text is empty: its only token is the end. Long texts are scored whole, in blocks.
    - Repeated rows count as often as they occur. Null ids are rows like others.
    - Without training rows every symbol is equally likely and no word is known.
    - An empty table gives an empty table. Other columns are left out.
    """
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = kept(gathered(rows.filter("train")), "lm-counts")
    words = counts.filter(F.col("kind") == WORD)
    totals = words.agg(F.sum("times").alias("n"), F.count("*").alias("v")).first()
    ends = rows.filter("train").count()
    n, v = (totals["n"] or 0) + ends, totals["v"] + (1 if ends else 0)
    whole = n + ADDED * (v + 1)
    levels, written = learned(counts)
    top = most(words, TOP_WORDS)
    context = docs.sparkSession.sparkContext
    sent = context.broadcast((levels, top[0], np.log10((top[1] + ADDED) / whole)))
    end_score, end_known = float(np.log10((ends + ADDED) / whole)), int(ends > 0)
    id_type = rows.schema["doc"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, top_words, top_scores = sent.value
        model, table = Model(levels), Table(top_words)
        for batch in batches:
            n_rows = len(batch)
            tokens, known, base, total = (np.zeros(n_rows) for _ in range(4))
            rare_keys, rare_times, rare_lengths = [], [], np.zeros(n_rows, np.int64)
            far_keys, far_times, far_lengths = [], [], np.zeros(n_rows, np.int64)
            for first, hashes, offsets in hashed_words(batch.column(1)):
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                rows_here = slice(first, first + len(offsets) - 1)
                size = len(offsets) - 1
                words = hashes.view(np.int64)
                at = table.find(words)
                found = at >= 0
                tokens[rows_here] = np.diff(offsets)
                known[rows_here] = np.bincount(owner[found], minlength=size)
                base[rows_here] = np.bincount(owner[found], pick(top_scores, at[found]), minlength=size)
                distinct, times, rare_lengths[rows_here] = runs(words[~found], owner[~found], size)
                rare_keys.append(distinct)
                rare_times.append(times)
            for keys, owner in blocks(batch.column(1)):
                low = int(owner[0])
                values = model.scores(keys)
                far = np.isnan(values)
                sums = np.bincount(owner - low, np.where(far, 0.0, values))
                total[low : low + len(sums)] += sums
                if far.any():
                    distinct, times, lengths = runs(keys[far], owner[far] - low, len(sums))
                    far_keys.append(distinct)
                    far_times.append(times)
                    far_lengths[low : low + len(sums)] += lengths
            offsets = pa.array(np.r_[0, np.cumsum(rare_lengths)].astype(np.int32))
            far_offsets = pa.array(np.r_[0, np.cumsum(far_lengths)].astype(np.int32))
            join = lambda parts, kind: pa.array(np.concatenate([*parts, np.zeros(0, kind)]).astype(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array((tokens + 1).astype(np.int64)),
                    pa.array(known.astype(np.int64) + end_known),
                    pa.array(base + end_score),
                    pa.array(total),
                    pa.ListArray.from_arrays(offsets, join(rare_keys, np.int64)),
                    pa.ListArray.from_arrays(offsets, join(rare_times, np.int32)),
                    pa.ListArray.from_arrays(far_offsets, join(far_keys, np.int64)),
                    pa.ListArray.from_arrays(far_offsets, join(far_times, np.int32)),
                ],
                names=["doc", "n_tokens", "known", "base", "score", "rare", "times", "far", "far_times"],
            )

    ddl = f"doc {id_type}, n_tokens bigint, known bigint, base double, score double, rare array<bigint>, times array<int>, "
    ddl += "far array<bigint>, far_times array<int>"
    local = rows.select("doc", "text").mapInArrow(score, ddl)
    local = kept(local.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    rare = local.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
    rare = rare.select("row", F.col("w.rare").alias("key"), F.col("w.times").alias("tf"))
    looked_up = rare.join(words.select("key", F.col("times").alias("c")), "key", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = looked_up.groupBy("row").agg(
        F.sum(F.col("tf") * F.log10((c + F.lit(ADDED)) / F.lit(whole))).alias("rare_base"),
        F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("rare_known"),
    )
    score_sum = F.col("score")
    if written:
        far = local.select("row", F.explode(F.arrays_zip("far", "far_times")).alias("g"))
        far = far.select("row", F.col("g.far").alias("key"), F.col("g.far_times").alias("tf"))
        asked = kept(far.select("key").distinct(), "lm-asked")
        far = far.join(looked_up_scores(asked, written).withColumnRenamed("score", "far_one"), "key", "left")
        far = far.groupBy("row").agg(F.sum(F.col("tf") * F.col("far_one")).alias("far_score"))
        local = local.join(far, "row", "left")
        score_sum += F.coalesce("far_score", F.lit(0.0))
    return local.join(sums, "row", "left").select(
        "doc",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        score_sum.alias("score"),
    )


def held_out(doc_id: Column, parts: int = 10) -> Column:
    """Whether the document is kept out of training; a null id is not."""
    return F.coalesce(fold(doc_id, parts) == 0, F.lit(False))
