"""Skill search: banded candidates, then verification."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.operators.block_join import (
    Kernel,
    Limits,
    Matches,
    Search,
    best_of_each,
    fixed_matrix,
    flat_ids,
    id_bytes,
    match_counts,
    measured,
    reaching,
    rounded,
)
from pairwell.operators.ranking import as_channel
from pairwell.operators.sketch import MAX_HASH, NUM_PERM, THRESHOLD, optimal_bands
from pairwell.operators.terms import TermIndex, encode_terms, term_hits

PAIRS_AT_A_TIME = 200_000


class SketchKernel(Kernel):
    """Postings that share a band with a profile, scored by equal positions."""

    def __init__(self, bands: int, rows: int, digits: int | None = None):
        self.bands, self.rows, self.digits = bands, rows, digits

    def prepare(self, profiles: pa.Table) -> SimpleNamespace:
        profiles = profiles.filter(pa.array(_filled(fixed_matrix(profiles.column("signature")))))
        sketches = fixed_matrix(profiles.column("signature"))
        keys = self._band_keys(sketches)
        order = np.argsort(keys, axis=0, kind="stable")
        return SimpleNamespace(
            ids=flat_ids(profiles.column("cv_id")),
            sketches=sketches,
            order=order,
            keys=np.take_along_axis(keys, order, axis=0),
        )

    def matches(self, state: SimpleNamespace, postings: pa.RecordBatch, floor: np.ndarray, k: int) -> Matches:
        sketches = fixed_matrix(postings.column("signature"))
        profile, posting = self._candidates(state, sketches)
        score = np.empty(len(profile))
        for start in range(0, len(profile), PAIRS_AT_A_TIME):
            part = slice(start, start + PAIRS_AT_A_TIME)
            score[part] = (state.sketches[profile[part]] == sketches[posting[part]]).mean(axis=1)
        return reaching(profile, posting, rounded(score, self.digits), floor)

    def _candidates(self, state: SimpleNamespace, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (profile, posting) that share a band, each once."""
        filled, codes = _filled(sketches), []
        for band, keys in enumerate(self._band_keys(sketches).T):
            known = state.keys[:, band]
            first = np.searchsorted(known, keys, side="left")
            count = np.where(filled, np.searchsorted(known, keys, side="right") - first, 0)
            posting = np.repeat(np.arange(len(keys)), count)
            within = np.arange(len(posting)) - np.repeat(np.cumsum(count) - count, count)
            profile = state.order[np.repeat(first, count) + within, band]
            if self.rows > 1:
                # Keys of several rows are mixed, so confirm the rows themselves.
                part = slice(band * self.rows, (band + 1) * self.rows)
                same = (state.sketches[profile, part] == sketches[posting, part]).all(axis=1)
                profile, posting = profile[same], posting[same]
            codes.append(profile * len(sketches) + posting)
        pairs = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
        return np.divmod(pairs, max(len(sketches), 1))

    def _band_keys(self, sketches: np.ndarray) -> np.ndarray:
        used = sketches[:, : self.bands * self.rows].reshape(-1, self.bands, self.rows)
        weights = np.int64(2654435761) ** np.arange(self.rows, dtype=np.int64)
        return (used * weights).sum(axis=2)


class ExactJaccardKernel(SketchKernel):
    """Same candidates, scored by the exact Jaccard of their token sets."""

    def prepare(self, profiles: pa.Table) -> SimpleNamespace:
        profiles = profiles.filter(pa.array(_filled(fixed_matrix(profiles.column("signature")))))
        state = super().prepare(profiles)
        tokens = flat_ids(profiles.column("tokens"))
        state.index = TermIndex.from_lists(tokens)
        state.sizes = tokens.value_lengths().to_numpy()
        return state

    def encode(self, state: SimpleNamespace, postings: pa.RecordBatch) -> pa.RecordBatch:
        return encode_terms(state.index, postings)

    def matches(self, state: SimpleNamespace, postings: pa.RecordBatch, floor: np.ndarray, k: int) -> Matches:
        profile, posting = self._candidates(state, fixed_matrix(postings.column("signature")))
        lists = postings.column("tokens")
        hits = term_hits(state.index, lists)
        cells, sums = state.index.add_up(hits, np.ones(len(hits.term)), len(lists))
        wanted = profile * len(lists) + posting
        at = np.minimum(np.searchsorted(cells, wanted), max(len(cells) - 1, 0))
        shared = np.where(cells[at] == wanted, sums[at], 0) if len(cells) else np.zeros(len(wanted))
        sizes = lists.value_lengths().to_numpy()
        jaccard = shared / (state.sizes[profile] + sizes[posting] - shared)
        return reaching(profile, posting, rounded(jaccard, self.digits), floor)


def _filled(sketches: np.ndarray) -> np.ndarray:
    """Rows that are not the all-maxima sketch of the empty set, which equals any other one."""
    return (sketches != MAX_HASH).any(axis=1)


def lsh_search(
    profiles: DataFrame,
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    verify: str = "sketch",
    source: str = "lsh_minhash",
    digits: int | None = None,
    profile_signature: str = "signature",
    posting_signature: str = "signature",
) -> Search:
    """Search for the candidates most like every profile's skills."""
    kernels = {"sketch": SketchKernel, "exact": ExactJaccardKernel}
    if verify not in kernels:
        raise ValueError(f"verify must be one of {sorted(kernels)}")
    words = ["tokens"] if verify == "exact" else []
    asked = profiles.select("cv_id", F.col(profile_signature).alias("signature"), *words)
    kernel = kernels[verify](*optimal_bands(threshold, num_perm), digits)
    size = measured(asked, _row_bytes(verify) + id_bytes())
    return Search(source, kernel, asked, size, {"signature": posting_signature} | {w: w for w in words})


def lsh_topk(
    profiles: DataFrame,
    postings: DataFrame,
    k: int,
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    verify: str = "sketch",
    source: str = "lsh_minhash",
    limits: Limits = Limits(),
    digits: int | None = None,
) -> DataFrame:
    """The ``k`` candidates most like every profile's skills; ``digits`` rounds scores before they rank.

    Both sides have an id and ``signature``; ``verify="exact"`` also needs ``tokens``,
    the distinct normalised skills.
    Candidates share at least one band; however many share a hot bucket, they
    are scored inside the task that holds them and only the best leave it.
    """
    search = lsh_search(profiles, threshold, num_perm, verify, source, digits)
    return as_channel(best_of_each([search], postings, k, limits), k)


def lsh_candidate_counts(
    profiles: DataFrame,
    postings: DataFrame,
    threshold: float = THRESHOLD,
    num_perm: int = NUM_PERM,
    limits: Limits = Limits(),
) -> DataFrame:
    """How many postings share a band with every profile."""
    return match_counts(lsh_search(profiles, threshold, num_perm), postings, limits)


def _row_bytes(verify: str) -> Column:
    width = F.size("signature") * 8 + 16
    if verify == "exact":
        width = width + F.octet_length(F.array_join("tokens", " ")) + 8 * F.size("tokens")
    return width
