"""N-gram Jaccard join by T-occurrence search with DivideSkip.

Two sets link when ``100 * overlap >= percent * union``. For a set of ``n`` shingles that
asks for at least ``T = ceil(percent * n / 100)`` shared ones, so a partner occurs in T of
the ``n`` inverted lists of its shingles. DivideSkip divides those lists: the long ones are
not merged; a partner must occur in one of the other ``n - T + 1`` short lists, and what
it has in the long ones is found by binary search.

1. Shingle counts over all documents order the lists by length (``frequent``): a block
   reports the shingles that it holds ``BLOCK_LEAST`` times. They decide the order only.
2. Documents with equal sets form a class; its smallest id stands for it.
3. Short lists are built by a shuffle on the shingle. A list of up to ``SHORT`` documents is
   merged at once into pairs whose sizes allow a link; pairs with too few common lists go.
4. Longer lists are resolved in rounds: some documents outside the list's largest component
   are held against all others that are not yet in theirs. A large group of near copies is one
   component after the first rounds, so its pairs are never made. Documents with more shingles
   of their own than a link allows are left out of the rounds (``lone``).
5. Pairs are held against each other by bucketed counts first (``SKETCH`` bytes a document): how many
   shingles fall into each bucket bounds the overlap from above. Documents that share a passage and
   little else end here, before any text moves.
6. The other pairs are verified in cells of one query and a bounded number of candidates: the cell
   builds inverted lists over its candidates, merges the short ones with a heap that skips,
   and probes the long ones.

Every link between different sets that decides the components is found exactly; the
number of documents that share a shingle has no cap.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.common import kept, kept_small
from pairwell.llm.components import components
from pairwell.llm.words import shingle_sets

#: Shingles of a block that counts them, and the count from which a block reports one.
BLOCK = 1 << 22
BLOCK_LEAST = 4
#: Most frequent shingles whose place in the order is known to all tasks (16 bytes each).
FREQUENT = 1 << 18
#: Lists up to this length are merged into pairs at once.
SHORT = 24
#: Ids that are broadcast to pick documents, in bytes; more are joined.
SENT_BYTES = 16 << 20
#: Buckets in which a document's shingles are counted, by their first bits; a count stops at ``FULL``.
SKETCH, FULL = 256, 255
#: Candidates of a cell, and the growth of the number of documents held against a list per round.
CELL = 256
GROWTH = 4
#: DivideSkip's weight of a probe against a step of the merge.
MU = 0.0085


def least_overlap(percent: int, sizes):
    """Smallest overlap of two sets whose sizes have this sum."""
    return -(-percent * sizes // (100 + percent))


# --- DivideSkip ---------------------------------------------------------------------------


def divide_skip(lists: list[list[int]], least: int) -> dict[int, int]:
    """Ids in at least ``least`` of the sorted lists, with the number of lists.

    The longest lists are set apart. The others are merged with a heap that drops as many
    heads as can't suffice and skips ahead by binary search; their results are looked up in
    the long lists.
    """
    lists = sorted((x for x in lists if x), key=len)
    least = max(least, 1)
    if len(lists) < least:
        return {}
    set_apart = min(int(least / (MU * log2(max(len(lists[-1]), 2)) + 1)), least - 1)
    short, long = lists[: len(lists) - set_apart], lists[len(lists) - set_apart :]
    need = least - len(long)
    found: dict[int, int] = {}
    heap = [(x[0], k) for k, x in enumerate(short)]
    heapq.heapify(heap)
    at = [0] * len(short)
    while len(heap) >= need:
        first = heap[0][0]
        popped = []
        while heap and heap[0][0] == first:
            popped.append(heapq.heappop(heap)[1])
        if len(popped) >= need:
            count = len(popped)
            for k, x in enumerate(long):
                if count + len(long) - k < least:
                    break
                place = bisect_left(x, first)
                count += place < len(x) and x[place] == first
            if count >= least:
                found[first] = count
            target = first + 1
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap)[1])
            if not heap:
                break
            target = heap[0][0]
        for k in popped:
            at[k] = bisect_left(short[k], target, at[k])
            if at[k] < len(short[k]):
                heapq.heappush(heap, (short[k][at[k]], k))
    return found


def search(query: np.ndarray, candidates: list[np.ndarray], percent: int) -> list[int]:
    """Places of the candidates that link to the query; both are sorted sets."""
    if not len(query) or not candidates:
        return []
    sizes = [len(c) for c in candidates]
    lists: list[list[int]] = [[] for _ in range(len(query))]
    for place, candidate in enumerate(candidates):
        at = np.searchsorted(query, candidate)
        at[at == len(query)] = 0
        for k in at[query[at] == candidate].tolist():
            lists[k].append(place)
    least = least_overlap(percent, len(query) + min(sizes))
    counts = divide_skip(lists, least)
    return [c for c, n in counts.items() if n >= least_overlap(percent, len(query) + sizes[c])]


def sketch(one: np.ndarray) -> bytes:
    """How many shingles of a set fall into each bucket, ``FULL`` at most."""
    return np.minimum(np.bincount((one >> np.uint64(56)).astype(np.int64), minlength=SKETCH), FULL).astype(np.uint8).tobytes()


def may_link(query: tuple[int, np.ndarray], sizes: np.ndarray, sketches: np.ndarray, percent: int) -> np.ndarray:
    """Whether candidates of these sizes and bucket counts can link to the query.

    The overlap is no more than the smaller count of every bucket, and what full buckets don't show.
    """
    n, own = query
    most = np.minimum(sketches, own).sum(axis=1, dtype=np.int64)
    hidden = np.minimum(sizes - sketches.sum(axis=1, dtype=np.int64), n - int(own.sum(dtype=np.int64)))
    return most + np.maximum(hidden, 0) >= least_overlap(percent, n + sizes)


# --- sets ---------------------------------------------------------------------------------


def frequent(docs: DataFrame, size: int) -> np.ndarray:
    """The most frequent shingles in ascending order of their count, then value.

    Counts cover all documents; equal sets within a block count once.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, seen = [], 0, set()

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= BLOCK_LEAST
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often], pa.int64())], names=["shingle", "times"]
            )

        for batch in batches:
            for one in shingle_sets(batch.column(0), size):
                if not len(one) or (key := hash(one.tobytes())) in seen:
                    continue
                seen.add(key)
                held.append(one)
                total += len(one)
                if total >= BLOCK:
                    yield flush()
                    held, total, seen = [], 0, set()
        if held:
            yield flush()

    counted = docs.select("text").mapInArrow(count, "shingle bigint, times bigint")
    most = counted.groupBy("shingle").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "shingle").limit(FREQUENT)
    table = most.toArrow()
    values, times = table["shingle"].to_numpy().view(np.uint64), table["times"].to_numpy()
    return values[np.lexsort((values, times))]


def with_sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, n, d1, d2, rare, hot, sketch): set size, a digest of the set, the shingles of its short lists in order, bucket counts.

    ``rare`` are shingles that are not known to be frequent, ``hot`` those that are.
    """
    known = docs.sparkSession.sparkContext.broadcast(frequent(docs, size))
    id_type = docs.schema["doc"].dataType.simpleString()

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        by_value = np.argsort(known.value)
        values = known.value[by_value]

        def list_of(arrays: list[np.ndarray]) -> pa.Array:
            offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
            flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

        for batch in batches:
            counts, digests, rare, hot, sketches = [], [], [], [], []
            for one in shingle_sets(batch.column(1), size):
                n = len(one)
                counts.append(n)
                digests.append(blake2b(one.tobytes(), digest_size=16).digest())
                sketches.append(sketch(one))
                keep = n - -(-percent * n // 100) + 1 if n else 0
                if len(values):
                    at = np.minimum(np.searchsorted(values, one), len(values) - 1)
                    often = values[at] == one
                    order = np.sort(by_value[at[often]])[: max(0, keep - int((~often).sum()))]
                    rare.append(one[~often][:keep])
                    hot.append(known.value[order])
                else:
                    rare.append(one[:keep])
                    hot.append(one[:0])
            parts = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(np.ascontiguousarray(parts[:, 0])),
                    pa.array(np.ascontiguousarray(parts[:, 1])),
                    list_of(rare),
                    list_of(hot),
                    pa.array(sketches, pa.binary()),
                ],
                names=["doc", "n", "d1", "d2", "rare", "hot", "sketch"],
            )

    ddl = f"doc {id_type}, n bigint, d1 bigint, d2 bigint, rare array<bigint>, hot array<bigint>, sketch binary"
    return docs.select("doc", "text").mapInArrow(prefixes, ddl)


# --- lists --------------------------------------------------------------------------------


def merged_lists(postings: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists, and the rows of long ones.

    Postings (shingle, n, doc, place, hot) come sorted by shingle and n. A row with ``other`` (and
    its size ``m``) is a pair whose sizes allow a link; one without is a member of a list longer
    than ``SHORT``. A row without ``shingle`` counts (``n``) lists of several documents that a
    document with frequent shingles (``hot``) is in. A task holds ``SHORT`` rows of the list at
    hand besides its batch.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "n", "doc", "place", "other", "m"]
        held: pa.RecordBatch | None = None
        long_value: int | None = None

        def members(rows: pa.RecordBatch) -> pa.RecordBatch:
            nothing = [pa.nulls(len(rows), rows.schema.field("doc").type), pa.nulls(len(rows), pa.int64())]
            return pa.RecordBatch.from_arrays([*rows.columns[:4], *nothing], names=names)

        def shared(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            docs = rows.column(2).filter(rows.column(4))
            if len(docs):
                found = docs.value_counts()
                ids, counts = found.field("values"), found.field("counts")
                none = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([none, counts, ids, none, pa.nulls(len(ids), ids.type), none], names=names)

        def pairs(rows: pa.RecordBatch, value: np.ndarray) -> Iterator[pa.RecordBatch]:
            n = rows.column(1).to_numpy()
            for step in range(1, SHORT):
                if step >= len(value):
                    return
                i = np.flatnonzero(value[:-step] == value[step:])
                if not len(i):
                    return
                j = i + step
                near = 100 * n[i] >= percent * n[j]
                i, j = i[near], j[near]
                if len(i):
                    first, second = pa.array(i), pa.array(j)
                    yield pa.RecordBatch.from_arrays(
                        [*[c.take(first) for c in rows.columns[:4]], rows.column(2).take(second), rows.column(1).take(second)], names=names
                    )

        def handle(rows: pa.RecordBatch, last: bool) -> Iterator[pa.RecordBatch]:
            """All lists of the rows but the last one, which may go on; that one too at the end."""
            nonlocal held, long_value
            value = rows.column(0).to_numpy()
            begins = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
            lengths = np.diff(np.r_[begins, len(value)])
            is_long = lengths > SHORT
            if long_value is not None and value[0] == long_value:
                is_long[0] = True
            whole = np.ones(len(begins), bool)
            held = None
            long_value = int(value[-1]) if is_long[-1] else None
            if not last and not is_long[-1]:
                whole[-1] = False
                held = rows.slice(int(begins[-1]))
            long_rows = np.repeat(is_long, lengths)
            if long_rows.any():
                chosen = rows.filter(pa.array(long_rows))
                yield members(chosen)
                yield from shared(chosen)
            short_rows = np.repeat(whole & ~is_long & (lengths > 1), lengths)
            if short_rows.any():
                chosen = rows.filter(pa.array(short_rows))
                yield from shared(chosen)
                yield from pairs(chosen, value[short_rows])

        for batch in batches:
            if not len(batch):
                continue
            rows = batch
            if held is not None:
                rows = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            yield from handle(rows, last=False)
        if held is not None:
            yield from handle(held, last=True)

    doc = postings.schema["doc"].dataType.simpleString()
    sorted_rows = postings.select("shingle", "n", "doc", "place", "hot").repartition("shingle").sortWithinPartitions("shingle", "n", "doc")
    return sorted_rows.mapInArrow(merge, f"shingle bigint, n bigint, doc {doc}, place bigint, other {doc}, m bigint")


def promising(lists: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of short lists that occur together in as many lists as a link needs.

    A set has at most ``T - 1`` shingles outside its ``n - T + 1`` short lists. Of two sets,
    take the one whose short lists end first in the order: what they share beyond those lists
    is less than its T. So a link needs ``overlap - max(T) + 1`` common short lists. Lists too
    long to be merged here may be common as well, as many as the first of the two is in.
    """
    held = long.groupBy(F.col("doc").alias("long_doc")).agg(F.count("*").alias("long"))
    # Repeated ids have several sets: sizes belong to the pair of sets.
    pairs = (
        lists.filter("other IS NOT NULL AND doc <> other").groupBy("doc", "other", "n", "m").agg(F.count("*").alias("common"))
    )
    pairs = pairs.join(held, F.col("doc") == F.col("long_doc"), "left")
    needed = [F.ceil(percent * size / F.lit(100)) for size in (F.col("n"), F.col("m"))]
    overlap = F.ceil(percent * (F.col("n") + F.col("m")) / (100 + percent))
    enough = F.col("common") + F.coalesce("long", F.lit(0)) >= overlap - F.greatest(*needed) + 1
    return pairs.filter(enough).select(F.least("doc", "other").alias("a"), F.greatest("doc", "other").alias("b")).distinct()


def sent(ids: DataFrame) -> DataFrame:
    """A table of ids, to be broadcast if it takes up to ``SENT_BYTES``."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in ids.columns), F.lit(0))
    return F.broadcast(ids) if (ids.agg(F.sum(width)).first()[0] or 0) <= SENT_BYTES else ids


def in_cells(pairs: DataFrame, rows: DataFrame, check) -> DataFrame:
    """The pairs (a, b) that ``check`` finds, from ``rows(doc, ...)``.

    Cells hold one query and up to about ``CELL`` candidates, so a query's row comes once per cell. ``check``
    gets a batch of columns and yields a value per row, and is asked which candidates of a query hold.
    """
    value_of, found_of = check
    queries = pairs.groupBy("a").agg(F.ceil(F.count("*") / CELL).alias("cells"))
    salted = pairs.join(queries, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("cells")).alias("cell"))
    members = salted.select("a", "cell", F.col("b").alias("doc")).unionByName(
        salted.select("a", "cell", F.col("a").alias("doc")).distinct()
    )
    payload = [c for c in rows.columns if c != "doc"]
    joined = sent(kept(members, "cells", "zstd")).join(rows, "doc").withColumn("candidate", F.col("a") != F.col("doc"))
    joined = joined.repartition("a", "cell").sortWithinPartitions("a", "cell", "candidate")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries_held, held, found = None, [], [], []

        def links() -> None:
            for query in queries_held if held else ():
                for place in found_of(query, [s for _, s in held]):
                    found.append((cell[0], held[place][0]))

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            docs, candidate = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for key, doc, is_candidate, one in zip(keys, docs, candidate, value_of(batch.columns[4:])):
                if key != cell:
                    links()
                    cell, queries_held, held = key, [], []
                if not is_candidate:
                    queries_held.append(one)
                else:
                    held.append((doc, one))
                    if len(held) >= CELL:
                        links()
                        held = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field("doc").type) for x in zip(*found)], names=["a", "b"])
                found = []
        links()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, batch.schema.field("doc").type) for x in zip(*found)], names=["a", "b"])

    doc = rows.schema["doc"].dataType.simpleString()
    return joined.select("a", "cell", "doc", "candidate", *payload).mapInArrow(look, f"a {doc}, b {doc}").distinct()


def by_sketch(percent: int):
    """Check of rows (n, sketch)."""

    def value_of(columns: list[pa.Array]) -> Iterator[tuple[int, np.ndarray]]:
        for n, counts in zip(columns[0].to_pylist(), columns[1].to_pylist()):
            yield n, np.frombuffer(counts, np.uint8)

    def found_of(query, candidates) -> list[int]:
        sizes = np.array([n for n, _ in candidates], np.int64)
        return np.flatnonzero(may_link(query, sizes, np.stack([c for _, c in candidates]), percent)).tolist()

    return value_of, found_of


def by_text(size: int, percent: int):
    """Check of rows (text)."""
    return lambda columns: shingle_sets(columns[0], size), lambda query, candidates: search(query, candidates, percent)


def verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, from ``sketches(doc, n, sketch)`` and ``texts(doc, text)``."""
    likely = kept(in_cells(pairs, sketches, by_sketch(percent)), "likely-pairs")
    return in_cells(likely, texts, by_text(size, percent))


def possible(percent: int, first: str, second: str) -> Column:
    """Whether sizes, places in the order and shingles of their own let two members (n, place, lone) of a list link."""
    n1, n2 = F.col(f"{first}n"), F.col(f"{second}n")
    least = F.ceil(percent * (n1 + n2) / (100 + percent))
    most = [n - F.greatest(F.col(f"{who}place"), F.col(f"{who}lone")) for who, n in ((first, n1), (second, n2))]
    return F.least(*most) >= least


def next_pairs(lists: DataFrame, labels: DataFrame, held: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of ``held`` documents per list with the rest of it, and the lists without those documents.

    Lists within one component are done, and members that can't link with the smallest of
    their list go. The documents are taken outside the list's largest component, those with
    the fewest shingles of their own first: they are nearest to what the list has in common.
    """
    named = lists.join(labels.select(F.col("node").alias("doc"), "component"), "doc", "left")
    named = named.withColumn("component", F.coalesce("component", "doc"))
    sizes = named.groupBy("shingle", "component").agg(F.count("*").alias("rows"), F.min("n").alias("small"))
    largest = (
        sizes.groupBy("shingle")
        .agg(F.max(F.struct("rows", "component")).alias("largest"), F.count("*").alias("parts"), F.min("small").alias("small"))
        .filter("parts > 1")
        .select("shingle", "small", F.col("largest.component").alias("main"))
    )
    able = F.col("n") - F.col("lone") >= F.ceil(percent * (F.col("n") + F.col("small")) / (100 + percent))
    open_lists = kept_small(named.join(largest, "shingle").filter(able), "open-lists")
    first = Window.partitionBy("shingle").orderBy("lone", "n", "doc")
    pivots = (
        open_lists.filter("component <> main")
        .withColumn("turn", F.row_number().over(first))
        .filter(F.col("turn") <= held)
        .select("shingle", *[F.col(c).alias(f"p_{c}") for c in ("doc", "n", "place", "lone", "component")])
    )
    pivots = kept_small(pivots, "pivots")
    members = open_lists.select("shingle", *[F.col(c).alias(f"m_{c}") for c in ("doc", "n", "place", "lone", "component")])
    against = members.join(pivots, "shingle").filter("m_component <> p_component").filter(possible(percent, "m_", "p_"))
    pairs = against.select(F.least("p_doc", "m_doc").alias("a"), F.greatest("p_doc", "m_doc").alias("b")).distinct()
    rest = open_lists.join(pivots.select("shingle", F.col("p_doc").alias("doc")), ["shingle", "doc"], "left_anti")
    return pairs, rest.select("shingle", "n", "doc", "place", "lone")


def more_links(labels: DataFrame, pairs: DataFrame, sketches: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The labels with those of the pairs that link."""
    new = kept(verified(pairs, sketches, texts, size, percent), "links")
    if new.isEmpty():
        return labels
    joined = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new)
    return kept_small(components(joined), "labels")


def jaccard_components(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(doc, n, component) per row of ``docs``: size of its shingle set, and the smallest id reachable by links.

    - A shingle is ``size`` consecutive words, A-Z in lower case; a shorter text is one
      shingle. Null texts and texts without words have empty sets and link with nothing.
    - Documents link when ``100 * overlap >= percent * union``; equal sets always do.
    - Rows of the same id are one document that links where any of them does. A row with a
      null id links with nothing and has a null component.
    - An empty table gives an empty table. Other columns are left out.
    """
    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    sets = kept(with_sets(docs, size, percent), "shingle-sets")
    linkable = sets.filter("n > 0 AND doc IS NOT NULL")
    classes = kept(linkable.groupBy("d1", "d2").agg(F.min("doc").alias("rep")), "classes")
    # The id is a key of this join, so a class of very many copies is no hot key.
    own_class = (linkable.d1 == classes.d1) & (linkable.d2 == classes.d2) & (linkable.doc == classes.rep)
    reps = linkable.join(classes, own_class, "left_semi").select("doc", "n", "rare", "hot")
    rare = reps.select("n", "doc", (F.size("hot") > 0).alias("hot"), F.posexplode("rare").alias("place", "shingle"))
    rare = rare.withColumn("place", F.col("place").cast("bigint"))
    lists = kept(merged_lists(rare, percent), "lists")
    # A document with frequent shingles among its short lists has all its other shingles there.
    # Those that no list shares are in no such document, and count against a link in a frequent list.
    shared = lists.filter("shingle IS NULL").groupBy(F.col("doc").alias("shared_doc")).agg(F.sum("n").alias("shared"))
    hot = reps.filter(F.size("hot") > 0).select("n", "doc", F.size("rare").cast("bigint").alias("before"), F.posexplode("hot").alias("place", "shingle"))
    hot = hot.join(kept_small(shared, "shared"), F.col("doc") == F.col("shared_doc"), "left").select(
        "shingle", "n", "doc", (F.col("place") + F.col("before")).alias("place"),
        (F.col("before") - F.coalesce("shared", F.lit(0))).alias("lone"),
    )
    several = hot.groupBy("shingle").agg(F.count("*").alias("rows")).filter("rows > 1").select("shingle")
    in_rare = lists.filter("other IS NULL AND shingle IS NOT NULL").select("shingle", "n", "doc", "place", F.lit(0).cast("bigint").alias("lone"))
    long = kept_small(in_rare.unionByName(hot.join(several, "shingle").select("shingle", "n", "doc", "place", "lone")), "long-lists")
    pairs = kept(promising(lists, long, percent), "pairs")
    needed = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).unionByName(long.select("doc"))
    needed = sent(kept(needed.distinct(), "candidate-ids"))
    texts = kept(docs.join(needed, "doc", "left_semi"), "candidate-texts", "zstd")
    sketches = kept(sets.select("doc", "n", "sketch").join(needed, "doc", "left_semi"), "candidate-sketches")
    # First a pair for each document: in a group of near copies they mostly make one component,
    # and only pairs between components are left to verify.
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    labels = kept_small(components(verified(kept(first, "pairs"), sketches, texts, size, percent)), "labels")
    of_a, of_b = (labels.select(F.col("node").alias(c), F.col("component").alias(f"{c}_component")) for c in ("a", "b"))
    apart = ~F.coalesce("a_component", "a").eqNullSafe(F.coalesce("b_component", "b"))
    others = pairs.join(first, ["a", "b"], "left_anti").join(of_a, "a", "left").join(of_b, "b", "left").filter(apart)
    labels = more_links(labels, kept(others.select("a", "b"), "pairs"), sketches, texts, size, percent)
    held = 1
    while not long.isEmpty():
        found, rest = next_pairs(long, labels, held, percent)
        labels = more_links(labels, kept(found, "pairs"), sketches, texts, size, percent)
        long = kept_small(rest, "long-lists")
        held *= GROWTH
    members = sets.select("doc", "n", "d1", "d2").join(classes, ["d1", "d2"], "left")
    reached = members.join(labels, members.rep == labels.node, "left")
    own = F.coalesce("component", "rep", "doc")
    return reached.select("doc", "n", F.when(F.col("doc").isNotNull(), own).alias("component"))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group of linked ones: the one with the smallest id.

    All columns stay. Documents that link with nothing stay, also those without words and
    those with a null id; of rows with one id that is kept, one stays.
    """
    joined = jaccard_components(docs, doc_id=doc_id, text=text, size=size, percent=percent)
    # Only ids that go are joined, so a corpus of few copies moves little.
    gone = kept(joined.filter("doc <> component").select(F.col("doc").alias("gone_id")).distinct(), "gone")
    repeated = kept(
        joined.filter("doc = component").groupBy("doc").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("doc").alias("again_id")),
        "repeated-ids",
    )
    # Rows as structs: no column of theirs can clash with those of the joins.
    rows = docs.select(F.col(f"`{doc_id}`").alias("one_id"), F.struct("*").alias("row"))
    stay = rows.join(sent(gone), F.col("one_id") == F.col("gone_id"), "left_anti")
    if not repeated.isEmpty():
        single = stay.join(repeated, F.col("one_id") == F.col("again_id"), "left_anti")
        twice = stay.join(repeated, F.col("one_id") == F.col("again_id"), "left_semi").dropDuplicates(["one_id"])
        stay = single.unionByName(twice)
    return stay.select("row.*")
