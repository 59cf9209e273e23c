"""Collocations from counts of the longest windows only.

Every word leads a window of up to ``LONGEST`` words of its piece. The columns of a window are
the word and those after it (lead columns); a window that ends early is padded with nulls. Only
windows are counted; Spark's ROLLUP over the columns sums them into the counts of all shorter
phrases, since each occurrence of a phrase is the beginning of exactly one window.

Most windows of a corpus occur once or twice and would be shuffled for nothing. Two passes
count hashes (``frequent_hashes``): of words and pairs of neighbours first, then of the three and
four words whose pairs are frequent. A window is padded from the first place at which its
beginning is rarer than a phrase must be. A phrase of enough occurrences is never cut by that, so
its count stays exact, also where hashes collide: those only let a rare beginning pass. Words too
rare to begin a phrase are counted in a window of nulls alone, so the count of all words stays whole.

Blocks of words are tokenised and counted in numpy; hashes travel sorted, as differences, packed
per range of hashes, so that a block sends about two bytes a pair. The hashes that occur often
enough are sent to the tasks as a bitmap of bounded size; beyond that size rare pairs collide
with common ones more often, and windows become longer, not wrong.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.common import kept
from pairwell.llm.words import U, lowered, mix, text_bytes

LONGEST = 4
LEAST = 30
BEST = 2000
UNKNOWN = "und"
SCALE = 2_000_000
COVERED_PERCENT = 80

#: Bytes of text in a block whose pairs, or whose windows, are counted together.
BLOCK, WINDOW_BLOCK = 6 << 20, 2 << 20
#: Bits of a hash, and of the bitmap of frequent hashes at most (32 MB).
HASH_BITS, MAP_BITS = 40, 28
#: Hashes that a range merges at once.
MERGED = 1 << 23

#: Bytes between the words of a piece, and bytes that end a piece.
GAP = np.isin(np.arange(256), [0x20, 0x09])
END = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])


# --- blocks -------------------------------------------------------------------------------


@dataclass
class Words:
    """Words of a block in order: number of (language, word), and whether the next one is in the same piece."""

    ids: np.ndarray
    joined: np.ndarray
    #: Per number: language (a place in ``names``) and word, and their hash.
    lang_of: np.ndarray
    names: pa.Array
    words: pa.Array
    hashes: np.ndarray

    def langs(self, numbers: np.ndarray) -> pa.Array:
        return self.names.take(pa.array(self.lang_of[numbers]))


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash per row; equal hashes of different rows cost time only."""
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(offsets[:-1], np.diff(offsets)).astype(np.uint64)
    value = mix((data.astype(np.uint64) + U(1)) * U(0x9E3779B97F4A7C15) + place * U(0xC2B2AE3D27D4EB4F))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, dtype=np.uint64, out=sums[1:])
    return mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def words_of(texts: pa.Array, langs: pa.Array) -> Words:
    data, rows = text_bytes(texts)
    data = lowered(data)
    letter = ~(GAP[data] | END[data])
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = rows[(rows > 0) & (rows < len(data))]
    first[inner] = letter[inner]
    last = letter.copy()
    last[:-1] &= ~letter[1:]
    last[inner - 1] = letter[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(rows, start, side="right") - 1
    ends = np.cumsum(END[data], dtype=np.int32)
    joined = np.zeros(len(start), bool)
    if len(start):
        joined[:-1] = (row[1:] == row[:-1]) & (ends[start[1:]] == ends[end[:-1] - 1])
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    # Without the bytes between them, words lie as Arrow wants them.
    strings = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[letter])))
    known = strings.dictionary_encode()
    lang = langs.cast(pa.string()).fill_null(UNKNOWN).dictionary_encode()
    n_words = max(len(known.dictionary), 1)
    of_row = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    both = of_row[row] * n_words + known.indices.to_numpy(zero_copy_only=False) if len(start) else np.zeros(0, np.int64)
    distinct, ids = np.unique(both, return_inverse=True)
    lang_of, word_of = distinct // n_words, distinct % n_words
    word_hash, lang_hash = text_hashes(*text_bytes(known.dictionary)), text_hashes(*text_bytes(lang.dictionary))
    hashes = mix(word_hash[word_of] + lang_hash[lang_of] * U(0xD1342543DE82EF95)) if len(distinct) else np.zeros(0, np.uint64)
    return Words(ids.astype(np.int64), joined, lang_of, lang.dictionary, known.dictionary.take(pa.array(word_of)), hashes)


def cut_hash(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U(64 - HASH_BITS)


def blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Words]:
    """Words of consecutive rows (text, lang), about ``most`` bytes a block; a longer text is a block of its own."""
    held, size = [], 0
    for batch in batches:
        data_size = np.diff(text_bytes(batch.column(0))[1])
        at = 0
        while at < len(batch):
            room = np.searchsorted(np.cumsum(data_size[at:]), max(most - size, 0), side="right")
            take = int(room) if room or held else 1
            if take:
                held.append(batch.slice(at, take))
                size += int(data_size[at : at + take].sum())
                at += take
            if at < len(batch) or size >= most:
                yield words_of(*columns(held))
                held, size = [], 0
    if held:
        yield words_of(*columns(held))


def columns(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([b.column(k).cast(pa.large_string()) for b in batches]) for k in (0, 1)]


# --- frequent hashes ----------------------------------------------------------------------


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted hashes as differences in byte planes, and counts (up to ``LEAST``), compressed."""
    steps = np.diff(values, prepend=U(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T[: HASH_BITS // 8])
    raw = len(values).to_bytes(8, "little") + planes.tobytes() + np.minimum(counts, LEAST).astype(np.uint8).tobytes()
    return pa.compress(raw, "zstd", asbytes=True) + len(raw).to_bytes(8, "little")


def unpacked(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(block[:-8], int.from_bytes(block[-8:], "little"), "zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    planes = np.zeros((8, n), np.uint8)
    planes[: HASH_BITS // 8] = np.frombuffer(raw, np.uint8, n * (HASH_BITS // 8), 8).reshape(HASH_BITS // 8, n)
    counts = np.frombuffer(raw, np.uint8, n, 8 + n * (HASH_BITS // 8))
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64), counts


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes with the sums of their counts, ``LEAST`` at most."""
    values = np.concatenate([v for v, _ in parts])
    counts = np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values = values[order]
    begins = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    sums = np.add.reduceat(counts[order].astype(np.int64), begins) if len(values) else np.zeros(0, np.int64)
    return values[begins], np.minimum(sums, LEAST).astype(np.uint8)


def joined_hashes(words: Words) -> list[np.ndarray]:
    """Hash of the beginning of 1 to ``LONGEST`` words at every word; those that a piece ends are of no use."""
    out = [words.hashes[words.ids]]
    for k in range(1, LONGEST):
        out.append(mix(out[-1][: len(words.ids) - k] * U(0x9FB21C651E98DF25) + out[0][k:] + U(k)))
    return out


def reached(words: Words, hashes: list[np.ndarray], known: list[Bitmap]) -> list[np.ndarray]:
    """Per number of words, where that many follow in the piece and all shorter beginnings, here and after, may be frequent.

    ``known`` holds what is known so far: words and pairs, then three and four words.
    """
    n = len(words.ids)
    alive = [np.ones(n, bool)]
    for k in range(1, LONGEST + 1):
        if k > 1:
            # A beginning of k words needs those of k - 1 words at both of its ends.
            whole = alive[-1][: max(n - k + 1, 0)] & alive[-1][1 : max(n - k + 2, 1)][: max(n - k + 1, 0)]
            if k == 2:
                whole &= words.joined[: max(n - 1, 0)]
            alive.append(whole)
        if (k - 1) // 2 < len(known):
            at = np.flatnonzero(alive[-1])
            kept_at = at[known[(k - 1) // 2].may_hold(hashes[k - 1][at])]
            alive[-1] = np.zeros(len(alive[-1]), bool)
            alive[-1][kept_at] = True
    return alive


def frequent_hashes(docs: DataFrame, *known: Bitmap) -> DataFrame:
    """(hash) of beginnings that occur ``LEAST`` times in a language; others may be among them.

    ``docs`` holds text and lang. First come words and pairs; with their bitmap, three and four words. Each range
    of hashes is merged by one task from one packed row per block, so a common pair is no hot key.
    """
    # As many ranges as the scan has parts: a range merges about what one part sends.
    ranges = max(docs.rdd.getNumPartitions(), 8)
    sent = docs.sparkSession.sparkContext.broadcast(list(known))
    level = 2 * len(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(1, ranges) * ((1 << HASH_BITS) / ranges)).astype(np.uint64)
        for words in blocks(batches, BLOCK):
            hashes = joined_hashes(words)
            alive = reached(words, hashes, sent.value)
            found = np.concatenate([cut_hash(hashes[k][alive[k]]) for k in (level, level + 1)])
            values, counts = np.unique(found, return_counts=True)
            cuts = [0, *np.searchsorted(values, edges).tolist(), len(values)]
            parts = [(r, packed(values[a:b], counts[a:b])) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], names=["part", "block"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size = None, [], 0

        def often() -> pa.RecordBatch:
            values, counts = summed(held)
            return pa.RecordBatch.from_arrays([pa.array(values[counts >= LEAST].view(np.int64))], names=["hash"])

        for batch in batches:
            for of, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if of != part and held:
                    yield often()
                    held, size = [], 0
                part = of
                held.append(unpacked(block))
                size += len(held[-1][0])
                if size > MERGED:
                    held = [summed(held)]
                    # What is left may be large already: merge again when as much has come anew.
                    size = 0
        if held:
            yield often()

    rows = docs.mapInArrow(count, "part int, block binary").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(merge, "hash bigint")


@dataclass
class Bitmap:
    """Set bits for hashes: whether one may be in the set."""

    bits: np.ndarray
    size: int

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = (cut_hash(hashes) >> U(HASH_BITS - self.size)).astype(np.int64)
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1)).astype(bool)


def bitmap(frequent: DataFrame) -> Bitmap:
    """A bit for the first bits of every hash: 16 bits a hash or more, 2^``MAP_BITS`` bits at most."""
    size = min(max(16, (frequent.count() * 16).bit_length()), MAP_BITS)
    slot = F.shiftright("hash", HASH_BITS - size)
    chunks = frequent.groupBy(F.shiftright(slot, 15).alias("chunk")).agg(F.bitmap_construct_agg(slot.bitwiseAND(F.lit(32767))).alias("bits"))
    table = chunks.toArrow()
    bits = np.zeros(max(1 << size >> 3, 4096), np.uint8)
    for chunk, part in zip(table["chunk"].to_pylist(), table["bits"].to_pylist()):
        bits[chunk * 4096 : chunk * 4096 + 4096] = np.frombuffer(part, np.uint8)
    return Bitmap(bits, size)


# --- windows ------------------------------------------------------------------------------

COLUMNS = [f"w{k + 1}" for k in range(LONGEST)]


def windows(docs: DataFrame, *known: Bitmap) -> DataFrame:
    """(lang, w1 .. w4, n): padded windows and how often each occurs in a block of ``docs(text, lang)``."""
    sent = docs.sparkSession.sparkContext.broadcast(list(known))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in blocks(batches, WINDOW_BLOCK):
            n, ids = len(words.hashes), words.ids
            alive = [np.r_[a, np.zeros(len(ids) - len(a), bool)] for a in reached(words, joined_hashes(words), sent.value)]
            # Words that end before a second column: counted per word, or per language if too rare.
            singles = np.bincount(ids[~alive[1]], minlength=n)
            begin = np.flatnonzero(alive[1])
            # Columns as numbers from 1, 0 for padding; two of them make one key.
            padded = np.r_[ids + 1, np.zeros(LONGEST, np.int64)].astype(np.uint64)
            later = [np.where(alive[k][begin], padded[begin + k], U(0)) for k in range(1, LONGEST)]
            wide = U(n + 1)
            left, right = padded[begin] * wide + later[0], later[1] * wide + later[2]
            order = np.lexsort((right, left))
            left, right = left[order], right[order]
            new = np.flatnonzero(np.r_[True, (left[1:] != left[:-1]) | (right[1:] != right[:-1])]) if len(order) else np.zeros(0, np.int64)
            times = np.diff(np.r_[new, len(order)])
            places = [left[new] // wide, left[new] % wide, right[new] // wide, right[new] % wide]
            enough = np.zeros(n, bool)
            enough[ids[alive[0]]] = True
            single, rare = np.flatnonzero((singles > 0) & enough), np.flatnonzero((singles > 0) & ~enough)
            of_lang = np.bincount(words.lang_of[rare], weights=singles[rare], minlength=len(words.names)).astype(np.int64)
            nameless = np.flatnonzero(of_lang)
            # Windows of several columns, of one, and of none.
            wider = [p.astype(np.int64) - 1 for p in places]
            one = np.r_[single, np.full(len(nameless), -1)]
            shown = [np.r_[wider[0], one]] + [np.r_[w, np.full(len(one), -1)] for w in wider[1:]]
            out = [pa.concat_arrays([words.langs(wider[0]), words.langs(single), words.names.take(pa.array(nameless))])]
            out += [words.words.take(pa.array(s, pa.int64(), mask=s < 0)).cast(pa.string()) for s in shown]
            out += [pa.array(np.r_[times, singles[single], of_lang[nameless]].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, names=["lang", *COLUMNS, "n"])

    ddl = "lang string, " + ", ".join(f"{c} string" for c in COLUMNS) + ", n bigint"
    return docs.mapInArrow(count, ddl)


def phrase(words: list[str]) -> Column:
    return F.concat_ws(" ", *words)


def phrase_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, size, phrase, f): phrases of 1 to ``LONGEST`` words that occur ``LEAST`` times, and per language size 0, f all words.

    ROLLUP sums the windows over ever shorter beginnings: a phrase of k words is the first k
    columns, where none of them is padding.
    """
    narrow = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    known: list[Bitmap] = []
    for _ in range(LONGEST // 2):
        known.append(bitmap(kept(frequent_hashes(narrow, *known), "frequent-hashes")))
    # Windows are added up first: of the few that are left, ROLLUP then makes the shorter phrases.
    counted = windows(narrow, *known).groupBy("lang", *COLUMNS).agg(F.sum("n").alias("n"))
    sums = counted.rollup("lang", *COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    size = F.lit(LONGEST) - F.bit_count("level")
    last = F.coalesce(*[F.when(size == k, F.col(COLUMNS[k - 1])) for k in range(1, LONGEST + 1)])
    whole = ((size > 0) & (F.col("f") >= LEAST) & last.isNotNull()) | (size == 0)
    return sums.filter(whole).select("lang", size.cast("int").alias("size"), phrase(COLUMNS).alias("phrase"), "f")


# --- collocations -------------------------------------------------------------------------


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` collocations of each language.

    A-Z are lower-cased, texts split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into words
    ``[^\\x20\\x09]+``. A phrase of 2 to 4 words with ``a >= 30`` occurrences is scored by its worst
    cut into two: ``floor(2000000 * a / (l + r))`` with the counts of both parts; the earliest of equal cuts
    counts. It goes if a longer phrase around it has 80 % of its occurrences.

    - A null language is ``und``; null and empty texts have no words. Long texts are counted whole.
    - Repeated rows count as often as they come. Equal scores rank by ``a``, then by phrase.
    - An empty table gives an empty table. Other columns are left out; their names don't matter.
    """
    counts = kept(phrase_counts(docs, text=text, lang=lang), "phrase-counts")
    words = F.split("phrase", " ")
    of_size = lambda at, n: F.array_join(F.slice(F.col("words"), at, n), " ")
    candidates = counts.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"))
    parts = counts.filter("size >= 1").select("lang", "phrase", "f")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", of_size(F.lit(1), F.col("k")).alias("begin"), of_size(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    for part, count in (("begin", "l"), ("rest", "r")):
        named = parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
        cuts = cuts.join(named, ["lang", part])
    # 64 bits don't hold the product of a large count; decimal(38, 0) does.
    exact = F.expr(f"CAST({SCALE} AS DECIMAL(18, 0)) * CAST(a AS DECIMAL(20, 0)) div CAST(l + r AS DECIMAL(20, 0))")
    worst = cuts.withColumn("score", exact).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = (
        candidates.filter("size >= 3")
        .select("lang", "words", "size", F.col("a").alias("longer"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("part_size"))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("part_size") + 1)).alias("at"))
        .groupBy("lang", of_size(F.col("at"), F.col("part_size")).alias("phrase"))
        .agg(F.max("longer").alias("longer"))
    )
    covered = F.expr(f"100 * CAST(longer AS DECIMAL(30, 0)) >= {COVERED_PERCENT} * CAST(a AS DECIMAL(30, 0))")
    stay = worst.join(inner, ["lang", "phrase"], "left").filter(~F.coalesce(covered, F.lit(False)))
    stay = stay.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = stay.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= best)
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
