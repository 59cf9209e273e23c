"""Spelling variants: words of a vocabulary that are one edit apart, and the form that a rare one stands for.

Two words of m and m or m + 1 code points that are one edit apart differ first at some place
p. Words are grouped by a range of such places: with p in [lo, hi), both have the first ``lo``
and the last ``m - hi`` code points in common, and these make the group's key. Two ranges cover
all places, so each near pair is in exactly one group. A group of more than ``GROUP`` words is
split into the two halves of its range until groups are small; a range of one place leaves two
free code points at most, so every group becomes small and no key is hot.

Within a group, the sorted words are scanned with the rows of the edit matrix of every query.
A row belongs to a prefix: neighbours in the list share the rows of their longest common prefix
(LCP), so a row is computed once for all words that begin alike. Only the three places about the
diagonal can hold a distance of one (the band). Where all of them exceed one, the whole range
of words with that prefix is skipped. All queries of many groups advance together in numpy,
one column of code points at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import kept
from pairwell.llm.words import lowered, text_bytes

LEAST_CHARS, LEAST = 6, 5
#: A form must be this many times as frequent.
TIMES = 5
#: A run loses a code point if this divides its hash.
LOSES = 199

#: Words of a group; words and states that numpy handles at once.
GROUP = 4096
WORDS, STATES = 1 << 15, 1 << 20
#: Bytes of text in a block.
BLOCK = 8 << 20
#: Runs up to so many bytes get their hash from tables.
SHORT_RUN = 64
#: Beyond one edit.
FAR = np.int8(2)

CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
#: What one more byte 0 does to a CRC-32 without its first and last inversion.
STEP = CRC ^ CRC[0]


# --- vocabulary ---------------------------------------------------------------------------


def run_bounds(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``: ASCII letters, and byte C3 with the one after it."""
    letter = ((data >= 97) & (data <= 122)) | (data == 0xC3)
    letter[1:] |= data[:-1] == 0xC3
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    inner = rows[(rows > 0) & (rows < len(data))]
    first[inner], last[inner - 1] = letter[inner], letter[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def shifted(crc: np.ndarray, most: int) -> np.ndarray:
    """(rows x most + 1) CRC-32 parts of the beginnings ``crc`` when so many bytes follow."""
    out = np.empty((len(crc), most + 1), np.uint32)
    out[:, 0] = crc
    for k in range(most):
        out[:, k + 1] = STEP[out[:, k] & 255] ^ (out[:, k] >> 8)
    return out


def counted_runs(ids: list[str], texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words and their numbers in a block; a word may come twice."""
    data, rows = text_bytes(texts)
    data = lowered(data)
    start, end = run_bounds(data, rows)
    marks = np.r_[0, np.cumsum(data == 0xC3)]
    chars = (end - start) - (marks[end] - marks[start])
    long = chars >= LEAST_CHARS
    start, end, chars = start[long], end[long], chars[long]
    if not len(start):
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    letters = np.ascontiguousarray(data[np.cumsum(inside[:-1]) > 0])
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    known = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    words, number = known.dictionary, known.indices.to_numpy().astype(np.int64)
    row = np.searchsorted(rows, start, side="right") - 1
    key, times = np.unique(row * len(words) + number, return_counts=True)
    row, number = key // len(words), key % len(words)
    # The hash of "<id>:<run>" from the hashes of both parts.
    flat, at = text_bytes(words)
    sizes = np.diff(at)
    own = np.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint32)
    begins = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    table = shifted(begins, min(int(sizes.max()), SHORT_RUN))
    hashes = table[row, np.minimum(sizes[number], table.shape[1] - 1)] ^ own[number]
    for k in np.flatnonzero(sizes[number] > SHORT_RUN).tolist():
        a, b = at[number[k]], at[number[k] + 1]
        hashes[k] = zlib.crc32(flat[a:b], int(begins[row[k]]))
    loses = hashes % LOSES == 0
    counts = np.bincount(number[~loses], weights=times[~loses], minlength=len(words)).astype(np.int64)
    edited, edited_times = [], []
    for h, k, n in zip(hashes[loses].tolist(), number[loses].tolist(), times[loses].tolist()):
        word = words[k].as_py()
        if len(word) > LEAST_CHARS:
            place = h % len(word)
            edited.append(word[:place] + word[place + 1 :])
            edited_times.append(n)
    left = np.flatnonzero(counts)
    found = pa.concat_arrays([words.take(pa.array(left)), pa.array(edited, pa.large_string())])
    return found, np.r_[counts[left], np.array(edited_times, np.int64)]


def vocabulary(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n): words of ``LEAST_CHARS`` code points or more that occur ``least`` times or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).fill_null("").to_pylist(), batch.column(1)
            ends = text_bytes(texts)[1]
            row = 0
            while row < len(batch):
                last = max(int(np.searchsorted(ends, ends[row] + BLOCK, side="right")) - 1, row + 1)
                words, counts = counted_runs(ids[row:last], texts.slice(row, last - row))
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(counts)], names=["word", "n"])
                row = last

    narrow = docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).cast("string").alias("text"))
    counted = narrow.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# --- groups -------------------------------------------------------------------------------


def key_of() -> F.Column:
    same_begin = F.substr("word", F.lit(1), F.col("lo"))
    same_end = F.right("word", F.greatest(F.col("m") - F.col("hi"), F.lit(0)))
    return F.concat_ws(" ", "m", "lo", "hi", same_begin, same_end)


def grouped(words: DataFrame) -> DataFrame:
    """(key, word, n, m, lo, hi): every word in the groups of its length and of the one below, none with too many words."""
    length = F.length("word")
    sized = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("m")).filter(F.col("m") >= LEAST_CHARS)
    half = F.ceil(F.col("m") / 2).cast("int")
    ranges = F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))
    rows = sized.select("word", "n", "m", F.explode(ranges).alias("range")).select("word", "n", "m", "range.lo", "range.hi")
    rows = kept(rows.withColumn("key", key_of()), "spelling-groups")
    while True:
        large = rows.filter("hi - lo > 1").groupBy("key").count().filter(F.col("count") > GROUP).select("key")
        large = kept(large, "large-groups")
        if large.isEmpty():
            return rows
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.array(F.struct("lo", middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi").alias("hi")))
        split = rows.join(large, "key", "left_semi").select("word", "n", "m", F.explode(halves).alias("range"))
        split = split.select("word", "n", "m", "range.lo", "range.hi").withColumn("key", key_of())
        rows = kept(rows.join(large, "key", "left_anti").unionByName(split), "spelling-groups")


# --- scan of sorted groups ----------------------------------------------------------------


def codes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points as bytes in the same order (the byte C3 says nothing), and where words begin."""
    data, offsets = text_bytes(words)
    marks = np.r_[0, np.cumsum(data == 0xC3)]
    return data[data != 0xC3], offsets - marks[offsets]


def near_pairs(words: pa.Array, group: np.ndarray, m: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, word) of words of one group that are one edit apart and differ first in [lo, hi).

    Words come sorted within consecutive groups; m, lo and hi are those of each word's group.
    """
    flat, begin = codes_of(words)
    flat = np.r_[flat, np.zeros(1, np.uint8)]
    size = np.diff(begin)
    begin = begin[:-1]
    n = len(size)

    def code(k: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Code points of words at places, 0 beyond the ends."""
        there = (place >= 0) & (place < size[k])
        return np.where(there, flat[np.where(there, begin[k] + place, len(flat) - 1)], 0)

    first = np.r_[True, group[1:] != group[:-1]]
    # LCP of each word with the one before it; -1 where a group begins.
    lcp = np.where(first, -1, 0)
    same = np.flatnonzero(~first)
    depth = 0
    while len(same):
        same = same[(size[same] > depth) & (size[same - 1] > depth)]
        same = same[flat[begin[same] + depth] == flat[begin[same - 1] + depth]]
        lcp[same] += 1
        depth += 1
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], n]
    whole = np.cumsum(first) - 1
    none = np.zeros(0, np.int64)
    # A state: a query, the range [a, b) of words with the prefix, its row's band and where the prefix left the query (-1: not yet).
    states = [none, none, none, none.astype(np.int8), none.astype(np.int8), none.astype(np.int8), none]
    queries, found = [none], [none]
    entering = np.argsort(lo, kind="stable")
    depth, entered = 0, 0
    while len(states[0]) or entered < n:
        if not len(states[0]):
            depth = max(depth, int(lo[entering[entered]]))
        now = int(np.searchsorted(lo[entering], depth, side="right"))
        q = entering[entered:now]
        entered = now
        edge = np.full(len(q), 1 if depth else FAR, np.int8)
        new = [q, starts[whole[q]], ends[whole[q]], edge, np.zeros(len(q), np.int8), np.ones(len(q), np.int8), np.full(len(q), -1)]
        states = [np.concatenate(x) for x in zip(states, new)]
        # The word that ends here is the first of its range.
        q, a = states[0], states[1]
        ended = size[a] == depth
        gap = size[q] - depth
        distance = np.where(gap == -1, states[3], np.where(gap == 0, states[4], np.where(gap == 1, states[5], FAR)))
        both_long = (size[q] > m[q]) & (size[a] > m[q])
        hit = ended & (distance == 1) & ~both_long
        queries.append(q[hit])
        found.append(a[hit])
        states[1] = a + ended
        on = states[1] < states[2]
        states = [x[on] for x in states]
        begins = np.flatnonzero(lcp <= depth)
        left, right = np.searchsorted(begins, states[1]), np.searchsorted(begins, states[2])
        left = np.minimum(left, right)
        fan = right - left
        upto = np.cumsum(fan)
        alive: list[list[np.ndarray]] = []
        at = 0
        while at < len(fan):
            past = int(upto[at - 1]) if at else 0
            stop = max(int(np.searchsorted(upto, past + STATES, side="right")), at + 1)
            part = slice(at, stop)
            owner = np.repeat(np.arange(at, stop), fan[part])
            child = np.arange(len(owner)) - np.repeat(upto[part] - fan[part] - past, fan[part]) + np.repeat(left[part], fan[part])
            q, a = states[0][owner], begins[child]
            after = np.r_[begins, n][child + 1]
            b = np.minimum(after, states[2][owner])
            c = code(a, depth)
            x0, x1, x2 = (states[k][owner] for k in (3, 4, 5))
            y0 = np.minimum(x0 + (code(q, depth - 1) != c), x1 + 1)
            y1 = np.minimum(np.minimum(x1 + (code(q, depth) != c), x2 + 1), y0 + 1)
            y2 = np.minimum(x2 + (code(q, depth + 1) != c), y1 + 1)
            length = size[q]
            y0, y1, y2 = (np.where(length >= depth + k, np.minimum(y, FAR), FAR).astype(np.int8) for k, y in enumerate((y0, y1, y2)))
            out = states[6][owner]
            out = np.where((out < 0) & ((depth >= length) | (code(q, depth) != c)), depth, out)
            # Beyond one edit everywhere in the band, or first different at a place of another group.
            stay = (np.minimum(np.minimum(y0, y1), y2) < FAR) & ~((out < 0) & (depth + 1 >= hi[q])) & (out < hi[q])
            kept_states = [x[stay] for x in (q, a, b, y0, y1, y2, out)]
            alive.append(kept_states)
            at = stop
        states = [np.concatenate(x) for x in zip(*alive)] if alive else states
        depth += 1
    return np.concatenate(queries), np.concatenate(found)


def near_words(groups: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): per word, how many words are near it, and the most frequent of them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def result(rows: pa.RecordBatch) -> pa.RecordBatch:
            key = rows.column(0).dictionary_encode().indices.to_numpy()
            words, n = rows.column(1).cast(pa.large_string()), rows.column(2).to_numpy()
            q, w = near_pairs(words, key, *[rows.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5)])
            # Words are sorted, so the smaller place is the smaller word.
            order = np.lexsort((w, -n[w], q))
            q, w = q[order], w[order]
            begins = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[begins, len(q)])
            best = pa.array(w[begins])
            columns = [rows.column(1).take(pa.array(q[begins])), pa.array(counts), rows.column(2).take(best), rows.column(1).take(best)]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "near_n", "near"])

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < WORDS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            key = rows.column(0).dictionary_encode().indices.to_numpy()
            # All groups but the last, which may go on.
            whole = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
            if whole:
                yield result(rows.slice(0, whole))
            held = [rows.slice(whole)]
        if held:
            yield result(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    rows = groups.select("key", "word", "n", "m", "lo", "hi").repartition("key").sortWithinPartitions("key", "word")
    near = rows.mapInArrow(scan, "word string, n_near bigint, near_n bigint, near string")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("near")))
    sums = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return sums.select("word", "n_near", (-F.col("best.minus")).alias("near_n"), F.col("best.near").alias("near"))


# --- forms --------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of the chain of forms. Each round doubles the steps."""
    ends = kept(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("at"), F.col("root").alias("further"))
        joined = ends.join(further, F.col("root") == F.col("at"), "left")
        ends = kept(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if ends.filter("moved").isEmpty():
            return ends.select("word", "root")
        ends = ends.select("word", "root")


def spelling_variants(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary of ``docs``.

    A word is a run of Latin letters, A-Z in lower case. Words are near if one inserted, deleted or
    replaced code point makes one of the other. ``form`` is the most frequent near word (of
    equals the smallest) if it is at least ``times`` as frequent, ``root`` the last of the forms of forms.

    - Null and empty texts have no words; long texts and long words are read whole.
    - Rows count as often as they come, also those of one id. A null id is hashed as an empty text.
    - An empty table gives an empty table. Other columns are left out; their names don't matter.
    """
    words = kept(vocabulary(docs, doc_id=doc_id, text=text), "vocabulary")
    near = near_words(grouped(words))
    is_form = F.col("near_n") >= times * F.col("n")
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n"),
    )
    formed = kept(formed, "forms")
    ends = roots(formed.filter("form IS NOT NULL"))
    rooted = formed.join(ends, "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
