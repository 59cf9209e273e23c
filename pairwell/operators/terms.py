"""Vectorised lookup of profile terms in batches of token lists."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


USES_AT_A_TIME = 2_000_000


@dataclass
class TermHits:
    """Profile terms found in a batch: posting row, term number, occurrences."""

    posting: np.ndarray
    term: np.ndarray
    times: np.ndarray


@dataclass
class TermIndex:
    """Distinct profile terms, which profiles use each of them, and how much."""

    terms: pa.Array
    first: np.ndarray
    profile: np.ndarray
    weight: np.ndarray
    #: What a use of a term and the lesser ones of its profile can add to a posting together.
    reach: np.ndarray

    @classmethod
    def from_rows(cls, term: pa.Array, profile: np.ndarray, weight: np.ndarray, reach: np.ndarray | None = None) -> TermIndex:
        terms = pc.unique(term)
        number = pc.index_in(term, value_set=terms).to_numpy(zero_copy_only=False)
        order = np.argsort(number, kind="stable")
        first = np.searchsorted(number[order], np.arange(len(terms) + 1))
        return cls(terms, first, profile[order], weight[order], (weight if reach is None else reach)[order])

    @classmethod
    def from_lists(cls, lists: pa.Array) -> TermIndex:
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists)), lengths)
        return cls.from_rows(lists.flatten(), owner, np.ones(len(owner)))

    def add_up(
        self, hits: TermHits, gain: np.ndarray, postings: int, essential: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gain times weight of each (profile, posting) that shares a term.

        A cell is the number ``profile * postings + posting``; cells come in ascending order. With
        ``essential`` (of every use of a term), only cells that have an essential use are kept.
        """
        cells, sums = np.zeros(0, np.int64), np.zeros(0)
        rest: list[tuple[np.ndarray, np.ndarray]] = []
        for use, cell, gains in self._uses(hits, gain, postings):
            if essential is not None:
                kept = essential[use]
                if not kept.all():
                    rest.append((cell[~kept], gains[~kept]))
                    cell, gains = cell[kept], gains[kept]
            cells, where = np.unique(np.concatenate([cells, cell]), return_inverse=True)
            sums = np.bincount(where, np.concatenate([sums, gains]), minlength=len(cells))
        for cell, gains in rest if len(cells) else ():
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            known = cells[at] == cell
            sums += np.bincount(at[known], gains[known], minlength=len(cells))
        return cells, sums

    def _uses(self, hits: TermHits, gain: np.ndarray, postings: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Use, cell and weighted gain of every hit of every profile, some at a time."""
        users = np.diff(self.first)[hits.term]
        ends = np.cumsum(users)
        cuts = np.searchsorted(ends, np.arange(USES_AT_A_TIME, ends[-1] if len(ends) else 0, USES_AT_A_TIME))
        for part in np.split(np.arange(len(users)), cuts):
            count = users[part]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            use = np.repeat(self.first[hits.term[part]], count) + within
            yield use, self.profile[use] * postings + np.repeat(hits.posting[part], count), np.repeat(gain[part], count) * self.weight[use]


def encode_terms(index: TermIndex, postings: pa.RecordBatch) -> pa.RecordBatch:
    """Replace the words in column ``tokens`` by term numbers, null for other words."""
    lists = postings.column("tokens")
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    numbers = pc.index_in(lists.flatten(), value_set=index.terms)
    place = postings.schema.get_field_index("tokens")
    return postings.set_column(place, "tokens", pa.ListArray.from_arrays(pa.array(offsets), numbers))


def term_hits(index: TermIndex, lists: pa.Array) -> TermHits:
    """Occurrences of every term in every list of term numbers."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    found = lists.flatten()
    known = found.is_valid().to_numpy(zero_copy_only=False)
    posting = np.repeat(np.arange(len(lists)), lengths)[known]
    size = max(1, len(index.terms))
    code, times = np.unique(posting * size + found.drop_null().to_numpy(), return_counts=True)
    return TermHits(code // size, code % size, times)
