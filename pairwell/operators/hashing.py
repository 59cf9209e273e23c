"""Token hashes of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha1

import numpy as np
import pyarrow as pa

#: Token lists worked on at a time: what is made of their tokens takes many times the Arrow batch.
LISTS_AT_A_TIME = 2_000


def some_at_a_time(lists: pa.Array, make: Callable[[pa.Array], pa.Array], step: int = LISTS_AT_A_TIME) -> pa.Array:
    """``make`` over slices of a batch of token lists, as one array."""
    return pa.concat_arrays([make(lists.slice(start, step)) for start in range(0, max(1, len(lists)), step)])


def hashed_tokens(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List lengths, a code per token, and a 32-bit hash per code.

    The hash is the first four bytes of SHA-1, little-endian. Each distinct token
    of a batch is hashed once, however often it occurs.
    """
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    encoded = lists.flatten().dictionary_encode()
    words = encoded.dictionary.cast(pa.binary()).to_pylist()
    numbers = (int.from_bytes(sha1(word).digest()[:4], "little") for word in words)
    hashes = np.fromiter(numbers, dtype=np.uint64, count=len(words))
    return lengths, encoded.indices.to_numpy(zero_copy_only=False), hashes
