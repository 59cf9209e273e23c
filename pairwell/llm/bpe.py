"""Byte-level BPE in batched numpy merge rounds.

The distinct words of a block of texts lie as symbols in one flat array. A round finds
the lowest-ranked pair of every word, merges its occurrences in all words at once and
looks up only the pairs that changed, by binary search over the sorted pair keys. Words
without a pair that can merge leave the array. A later merge always has a higher rank
than the one that made its symbol, so the rounds merge in the order of the one-by-one rule.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters handled at once, and distinct words remembered by a task.
BLOCK_CHARS = 1 << 21
MEMORY_WORDS = 1 << 19
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary's file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    others = [b for b in range(256) if b not in printable]
    return letters | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Arrays of a byte-level BPE file: byte ids, sorted pair keys, the bytes of every id."""

    def __init__(self, content: str):
        data = json.loads(content)
        letters, ids = byte_letters(), data["model"]["vocab"]
        as_bytes = {token: bytes(letters[c] for c in token) for token in ids}
        self.byte_ids = np.zeros(256, np.int64)
        for token, raw in as_bytes.items():
            if len(raw) == 1:
                self.byte_ids[raw[0]] = ids[token]
        merges = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in merges], np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], np.int64)
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {i: as_bytes[t] for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` if it can't merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and the number of ids of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        ranks = np.full(len(symbols), NONE, np.int32)
        same = np.flatnonzero(owner[:-1] == owner[1:])
        ranks[same] = self.ranks(symbols[same], symbols[same + 1])
        done_symbols, done_owners = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(ranks, starts)
            lowest = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            ended = lowest == NONE
            if ended.any():
                done_symbols.append(symbols[ended])
                done_owners.append(owner[ended])
                going = ~ended
                symbols, owner, ranks, lowest = symbols[going], owner[going], ranks[going], lowest[going]
            at = np.flatnonzero(ranks == lowest)
            if not len(at):
                continue
            # In a run such as "aaa" every second pair merges.
            first = np.r_[True, np.diff(at) != 1]
            place = np.arange(len(at))
            at = at[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
            symbols[at] = self.merged[ranks[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            new = np.cumsum(stay)[at] - 1
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            changed = np.unique(np.r_[new, new[new > 0] - 1])
            ranks[changed] = NONE
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[owner[changed] == owner[changed + 1]]
            ranks[changed] = self.ranks(symbols[changed], symbols[changed + 1])
        if not done_owners:
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        owners = np.concatenate(done_owners)
        flat = np.concatenate(done_symbols)[np.argsort(owners, kind="stable")]
        return flat.astype(np.uint32), np.bincount(owners, minlength=len(words))


def pieces(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """The text cut where white space follows other characters; no word spans such a place."""
    at = 0
    edge = regex.compile(r"(?<=\S)(?=\s)")
    while len(text) - at > size:
        found = edge.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


class Encoder:
    """Ids of texts; remembers the ids of up to ``MEMORY_WORDS`` words.

    ``specials=False`` reads the strings of special tokens as ordinary text.
    """

    def __init__(self, vocabulary: Vocabulary, specials: bool = True):
        self.vocabulary = vocabulary
        self.split = regex.compile(PATTERN).findall
        marks = sorted(vocabulary.special, key=len, reverse=True) if specials else []
        self.specials = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.lengths, self.used = np.zeros(0, np.uint32), np.zeros(0, np.int64), 0

    def learn(self, words: list[str]) -> None:
        """Give the words that are not known yet their ids."""
        if len(self.index) > MEMORY_WORDS:
            self.forget()
        new = list({w for w in words if w not in self.index})
        if not new:
            return
        encoded = [w.encode("utf-8", "surrogatepass") for w in new]
        flat, lengths = self.vocabulary.merge(encoded)
        start = len(self.lengths)
        self.index.update(zip(new, range(start, start + len(new))))
        self.flat = np.concatenate([self.flat, flat])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.offsets = np.cumsum(self.lengths) - self.lengths

    def words_of(self, text: str) -> Iterator[list[str]]:
        for piece in pieces(text):
            yield self.split(piece)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in turn, and the number of ids of each."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.learn(words)
        rows = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        counts = self.lengths[rows]
        ends = np.cumsum(counts)
        gather = np.arange(ends[-1]) + np.repeat(self.offsets[rows] - ends + counts, counts)
        return self.flat[gather], counts

    def encode_one(self, text: str) -> np.ndarray:
        """Ids of a long text, piece by piece; special tokens are single ids."""
        parts = self.specials.split(text) if self.specials else [text]
        out = []
        for part in parts:
            if self.specials and part in self.vocabulary.special:
                out.append(np.array([self.vocabulary.special[part]], np.uint32))
            else:
                out.extend(self.ids_of(words)[0] for words in self.words_of(part))
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of every text; null is empty. Short texts share a block, long ones are cut."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            text = text or ""
            alone = len(text) > BLOCK_CHARS or (self.specials and any(mark in text for mark in self.vocabulary.special))
            if alone or size > BLOCK_CHARS:
                yield from self.block(held)
                held, size = [], 0
            if alone:
                yield self.encode_one(text)
            else:
                held.append(self.split(text))
                size += len(text)
        yield from self.block(held)

    def block(self, held: list[list[str]]) -> list[np.ndarray]:
        flat, counts = self.ids_of([w for words in held for w in words])
        sums = np.r_[0, np.cumsum(counts)]
        bounds = sums[np.cumsum([0, *map(len, held)])]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def read_vocabulary(path: str) -> str:
    """Content of the tokenizer's file on the driver; tasks get it by broadcast (its size is fixed)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def with_ids(docs: DataFrame, path: str, *, text: str = "text", ids: str = "ids", decoded: bool = False) -> DataFrame:
    """All columns of ``docs`` and the ids of the text as an array of ints.

    A null or empty text has no ids. ``<|endoftext|>`` and other added tokens in a text are
    their own id, as the tokenizers library has them. Texts are never cut; a long one is
    handled in pieces. Rows are handled one by one, so ties and repeated rows change nothing; an
    empty table gives an empty table. A column called ``ids`` is replaced. With ``decoded``, the
    task decodes the ids of every row again and ends the job if that is not the text (null being empty).
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(content.value))
        for batch in batches:
            texts = batch.to_pylist()
            arrays = list(encoder.encode(texts))
            if decoded and any(encoder.decode(found) != (value or "") for value, found in zip(texts, arrays, strict=True)):
                raise ValueError("ids that do not decode to their text")
            offsets = np.r_[0, np.cumsum([len(a) for a in arrays])].astype(np.int32)
            flat = np.concatenate([*arrays, np.zeros(0, np.uint32)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return docs.withColumn(ids, encode(F.col(text)))


def with_text(docs: DataFrame, path: str, *, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``docs`` and the text of the ids; null for null ids. A column called ``text`` is replaced."""
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf(T.StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(content.value))
        for batch in batches:
            rows = (row.as_py() for row in batch)
            yield pa.array([None if r is None else encoder.decode(np.array(r, np.uint32)) for r in rows], pa.string())

    return docs.withColumn(text, decode(F.col(ids)))


DIGEST_TYPE = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def round_trip(docs: DataFrame, path: str, *, text: str = "text", name: str = "round_trip") -> DataFrame:
    """All columns of ``docs`` and a struct: number of ids, and digests of the ids and of the text decoded from them.

    Ids are digested as little-endian unsigned 32-bit integers, text as UTF-8. Ids and text
    stay in the task, so only digests go back to Spark.

    - A null or empty text has no ids, and the digests of nothing. Long texts are encoded whole, in pieces.
    - Rows are handled one by one: ties, repeated rows and null ids of documents change nothing.
    - An empty table gives an empty table. A column called ``name`` is replaced.
    """
    content = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    @F.arrow_udf(DIGEST_TYPE)
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(Vocabulary(content.value))
        sha = hashlib.sha256
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for ids in encoder.encode(batch.to_pylist()):
                counts.append(len(ids))
                ids_digests.append(sha(ids.astype("<u4").tobytes()).hexdigest())
                text_digests.append(sha(encoder.decode(ids).encode()).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=DIGEST_TYPE.names,
            )

    return docs.withColumn(name, digests(F.col(text)))
