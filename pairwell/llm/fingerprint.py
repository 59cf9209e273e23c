"""Document fingerprints by randomised edit embedding.

Texts are cut where the last four characters hash to an anchor, so an edit moves the cuts
near it only. In each chunk a walk goes over the characters: at step ``j`` it reads one and
moves on if a bit shared by all texts, fixed by ``j`` and the character, says so. Two walks
over chunks of small edit distance soon read the same characters at the same steps again, so
edit distance becomes Hamming distance. All chunks of a block walk at once.

Banding: each of ``BANDS`` groups of steps is a sample of the embedding, hashed to a feature of
the document. The fingerprint keeps, for ``SLOTS`` parts of the feature space, four bits of the
smallest feature; equal slots estimate the share of common features. ``search`` finds
candidates by bands of the fingerprint and verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.common import kept
from pairwell.llm.words import U, mix

#: Characters looked at for a cut, mean and largest length of a chunk.
CONTEXT, MEAN, LONGEST = 4, 32, 64
#: Steps of a walk, samples per chunk, steps per sample.
STEPS, BANDS, SAMPLED = 128, 4, 12
SLOTS = 128
EMPTY = np.uint64(2**64 - 1)
#: Characters handled at once.
BLOCK = 1 << 20
#: Bands of a search: slots per band.
BAND_SLOTS = 8

_rng = np.random.default_rng(20240)
#: Shared by all texts: the bit of each step and character class, and the sampled steps.
MOVES = _rng.integers(0, 2, (STEPS, 256), dtype=np.uint8)
SAMPLES = np.stack([np.sort(_rng.choice(STEPS // 2 if b % 2 == 0 else STEPS, SAMPLED, replace=False)) for b in range(BANDS)])
WEIGHTS = mix(np.arange(1, BANDS * SAMPLED + 1, dtype=np.uint64)).reshape(BANDS, SAMPLED) | U(1)


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)


def chunk_starts(codes: np.ndarray, texts: np.ndarray, cut: int = 0) -> np.ndarray:
    """Where chunks begin; ``texts`` are the beginnings of the texts, ``cut`` is a chunk's beginning that is known."""
    key = np.zeros(len(codes), np.uint64)
    for k in range(CONTEXT):
        key[k:] += codes[: len(codes) - k] * U(0x9E3779B97F4A7C15 + 2 * k)
    places = np.arange(len(codes))
    first = np.zeros(len(codes), np.int64)
    first[texts] = texts
    # The first characters of a text have too few before them for an anchor.
    anchor = ((mix(key) & U(MEAN - 1)) == 0) & (places - np.maximum.accumulate(first) >= CONTEXT - 1)
    begins = np.r_[False, anchor[:-1]]
    begins[texts] = True
    begins[cut] = True
    last = np.maximum.accumulate(np.where(begins, places, 0))
    return np.flatnonzero((places - last) % LONGEST == 0)


def walks(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Features (chunks x ``BANDS``) of the sampled steps of every chunk's walk."""
    letters = mix(codes.astype(np.uint64) + U(1))
    classes = np.r_[(letters & U(255)).astype(np.uint8), np.uint8(0)]
    letters = np.r_[letters, U(0)]
    features = np.zeros((len(starts), BANDS), np.uint64)
    at, nothing = starts.copy(), len(codes)
    for step in range(STEPS):
        here = np.where(at < ends, at, nothing)
        for band, k in zip(*np.nonzero(SAMPLES == step)):
            features[:, band] += letters[here] * WEIGHTS[band, k]
        at += MOVES[step][classes[here]]
    return mix(features + np.arange(1, BANDS + 1, dtype=np.uint64))


def slot_minima(features: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Smallest feature of each row and slot; ``EMPTY`` without one."""
    out = np.full(rows * SLOTS, EMPTY, np.uint64)
    if len(features):
        place = np.repeat(owner, BANDS) * SLOTS + (features.ravel() & U(SLOTS - 1)).astype(np.int64)
        value = features.ravel() >> U(7)
        order = np.lexsort((value, place))
        place, value = place[order], value[order]
        first = np.r_[True, place[1:] != place[:-1]]
        out[place[first]] = value[first]
    return out.reshape(rows, SLOTS)


def hexed(minima: np.ndarray) -> list[str]:
    """Fingerprints; an empty slot takes the value of the next filled one, marked by the distance."""
    rows = len(minima)
    twice = np.hstack([minima, minima])
    places = np.where(twice != EMPTY, np.arange(2 * SLOTS), 4 * SLOTS)
    following = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]
    distance = following - np.arange(SLOTS)
    source = np.where(following < 2 * SLOTS, following, 0)
    filled = np.take_along_axis(twice, source, axis=1) + distance.astype(np.uint64) * U(0xD1342543DE82EF95)
    nibbles = (mix(filled) & U(15)).astype(np.uint8)
    nibbles[following >= 2 * SLOTS] = 0
    packed = (nibbles[:, ::2] << 4) | nibbles[:, 1::2]
    return [packed[k].tobytes().hex() for k in range(rows)]


def long_minima(codes: np.ndarray) -> np.ndarray:
    """Slot minima of one long text, slice by slice; a slice ends where a chunk does."""
    out = np.full((1, SLOTS), EMPTY, np.uint64)
    at = 0
    while at < len(codes):
        before = min(at, CONTEXT - 1)
        part = codes[at - before : at + BLOCK]
        starts = chunk_starts(part, np.array([0]), before)
        starts = starts[starts >= before]
        whole = at + BLOCK >= len(codes)
        ends = np.r_[starts[1:], len(part)]
        if not whole:
            starts, ends = starts[:-1], ends[:-1]
        features = walks(part, starts, ends)
        out = np.minimum(out, slot_minima(features, np.zeros(len(starts), np.int64), 1))
        at = len(codes) if whole else at - before + int(ends[-1])
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of every text: ``SLOTS`` hex digits; an empty text has zeros."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            codes = code_points(held)
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            offsets = np.cumsum(lengths) - lengths
            begins = offsets[lengths > 0]
            starts = chunk_starts(codes, begins) if len(codes) else np.zeros(0, np.int64)
            ends = np.r_[starts[1:], len(codes)][: len(starts)]
            owner = np.searchsorted(begins, starts, side="right") - 1
            owner = np.flatnonzero(lengths > 0)[owner] if len(starts) else owner
            out.extend(hexed(slot_minima(walks(codes, starts, ends), owner, len(held))))
            held.clear()

    size = 0
    for text in texts:
        if len(text) > BLOCK:
            flush()
            out.extend(hexed(long_minima(code_points([text]))))
            size = 0
            continue
        held.append(text)
        size += len(text)
        if size > BLOCK:
            flush()
            size = 0
    flush()
    return out


def alike(a: str, b: str) -> float:
    """Likeness of two fingerprints, 0 to 1: the share of features common to both, as a Dice coefficient."""
    if a == b:
        return 1.0
    equal = sum(x == y for x, y in zip(a, b)) / SLOTS
    common = max(0.0, (equal - 1 / 16) / (1 - 1 / 16))
    return 2 * common / (1 + common)


def edited(text: str, following: str) -> str:
    """The text with its last ``n // 2`` characters replaced by the first as many of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


ROW_DDL = (
    "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
)


def compared(rows: list[tuple], following: list[tuple]) -> list[list]:
    """Columns of ``ROW_DDL`` for rows (text, fingerprint) and the rows that follow them."""
    texts = [edited(t, f[0]) for (t, _), f in zip(rows, following)]
    prints = fingerprints(texts)
    return [
        [len(t) for t, _ in rows],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
        [p for _, p in rows],
        prints,
        [alike(p, q) for (_, p), q in zip(rows, prints)],
        [alike(p, f[1]) for (_, p), f in zip(rows, following)],
    ]


def with_fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row.

    The next document is the one with the next id; the first follows the last. Texts are dealt
    out by ranges of ids once and stream in order through each range, so a document meets the
    next one in its task. Only the last row of a range meets the first of the next range in a
    second step, of as many rows as there are ranges.

    - A null text is empty; an empty text has no features, and is like empty texts only.
    - Texts of a few characters may differ and still have equal fingerprints (``a`` and ``ab`` do): walks need
      some characters to tell texts apart. Repeated rows follow one another and are alike.
    - Null ids come first in order; rows of equal ids follow one another by text.
    - A single row follows itself. An empty table gives an empty table. Other columns are left out.
    """
    docs = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    id_type = docs.schema["doc"].dataType
    ranged = docs.repartitionByRange(F.col("doc").asc_nulls_first()).sortWithinPartitions(F.col("doc").asc_nulls_first(), "text")
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema_names = ["doc", *names, "part", "edge", "edge_text"]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        arrow_id = None
        held: list[tuple] = []  # the last row: id, text, fingerprint

        def record(ids: list, columns: list[list], edge: str | None, texts: list) -> pa.RecordBatch:
            n = len(ids)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, arrow_id), *[pa.array(c, k) for c, k in zip(columns, kinds)],
                 pa.array([part] * n, pa.int32()), pa.array([edge] * n, pa.string()), pa.array(texts, pa.string())],
                names=schema_names,
            )

        def edge_row(row: tuple, edge: str) -> pa.RecordBatch:
            doc, content, print_ = row
            return record([doc], [[None], [None], [print_], [None], [None], [None]], edge, [content])

        for batch in batches:
            arrow_id = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            at = 0
            while at < len(ids):
                size, end = 0, at
                chunk: list[str] = []
                while end < len(ids) and size < BLOCK:
                    chunk.append(texts[end].as_py())
                    size += len(chunk[-1])
                    end += 1
                rows = list(zip(ids[at:end], chunk, fingerprints(chunk)))
                if not held:
                    yield edge_row(rows[0], "first")
                both = held + rows
                if len(both) > 1:
                    pairs = [row[1:] for row in both]
                    yield record([row[0] for row in both[:-1]], compared(pairs[:-1], pairs[1:]), None, [None] * (len(both) - 1))
                held = both[-1:]
                at = end
        if held:
            yield edge_row(held[0], "last")

    ddl = f"doc {id_type.simpleString()}, {ROW_DDL}, part int, edge string, edge_text string"
    rows = kept(ranged.mapInArrow(stream, ddl), "fingerprints")
    firsts = rows.filter("edge = 'first'").select("part", F.col("edge_text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    order = Window.orderBy("part")
    # Numbers of the ranges that have rows: one narrow row per range.
    numbers = firsts.select("part").withColumn("next_part", F.lead("part").over(order)).withColumn("first_part", F.min("part").over(Window.partitionBy()))
    numbers = numbers.select(F.col("part").alias("this_part"), F.coalesce("next_part", "first_part").alias("next_part"))
    lasts = rows.filter("edge = 'last'").select("doc", "part", "edge_text", "fingerprint")
    seams = lasts.join(numbers, lasts.part == numbers.this_part).join(firsts.withColumnRenamed("part", "first_of"), F.col("next_part") == F.col("first_of"))

    def seam(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                values = [batch.column(c)[k].as_py() for c in range(1, 5)]
                columns = compared([(values[0], values[1])], [(values[2], values[3])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *map(pa.array, columns)], names=["doc", *names])

    closed = seams.select("doc", "edge_text", "fingerprint", "next_text", "next_print").mapInArrow(seam, f"doc {id_type.simpleString()}, {ROW_DDL}")
    return rows.filter("edge IS NULL").select("doc", *names).unionByName(closed)


# --- search -------------------------------------------------------------------------------


def likeness(a: Column, b: Column) -> Column:
    """``alike`` of two fingerprint columns."""
    equal = F.size(F.filter(F.sequence(F.lit(1), F.lit(SLOTS)), lambda k: F.substring(a, k, F.lit(1)) == F.substring(b, k, F.lit(1)))) / SLOTS
    common = F.greatest(F.lit(0.0), (equal - 1 / 16) / (1 - 1 / 16))
    return F.when(a == b, F.lit(1.0)).otherwise(2 * common / (1 + common))


def bands(prints: DataFrame, doc: str) -> DataFrame:
    values = F.array(*[F.substring("fingerprint", 1 + k, BAND_SLOTS) for k in range(0, SLOTS, BAND_SLOTS)])
    return prints.select(F.col("doc").alias(doc), F.col("fingerprint").alias(f"{doc}_print"), F.posexplode(values).alias("band", "value"))


def search(queries: DataFrame, prints: DataFrame, least: float = 0.8) -> DataFrame:
    """(query, doc, likeness): rows of ``prints(doc, fingerprint)`` that share a band with a query and are like it.

    Rows of equal fingerprints are searched as one, under their smallest id; nothing caps the
    candidates of a band. At a likeness of 0.9 a row is found with a probability above 0.97.
    """
    one = prints.filter("doc IS NOT NULL").groupBy("fingerprint").agg(F.min("doc").alias("doc"))
    found = bands(queries, "query").join(bands(one, "doc"), ["band", "value"]).select("query", "doc", "query_print", "doc_print").distinct()
    return found.withColumn("likeness", likeness(F.col("query_print"), F.col("doc_print"))).filter(F.col("likeness") >= least).select("query", "doc", "likeness")
