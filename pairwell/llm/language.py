"""Language identification by hierarchical discrimination.

Languages are grouped into families: the two groups whose mean profiles are most alike are
joined until ``ceil(sqrt(languages))`` groups are left, or the caller names the families. One
linear support vector machine per family tells it from the others; inside a family, one
machine per pair of languages votes.

A profile is the square root of the shares of hashed letter n-grams (1 to 4 bytes) over the
whole text. The machines are trained in one task from a sample of ``SAMPLE`` labelled
documents at most, spread evenly over the ``LANGUAGES`` languages that most documents state; the
driver gets the machines only. Prediction runs over every row in the tasks.

The machines always name a language. Whether a text is in it shows in two numbers that do not
depend on how many languages or families there are: the smallest raw margin of the machines
that the language won against, and the mean log likelihood of the text's n-grams under the
language's mean profile. ``calibrate`` learns how low both get for beginnings of labelled
texts of several lengths.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwell.llm.common import kept
from pairwell.llm.words import mix, text_bytes

#: Labelled documents that the machines are trained on, and languages that are learned, at most.
SAMPLE = 4000
LANGUAGES = 200
SIZE = 4096
HASHES = 1 << 40
GRAMS = 4
BLOCK = 1 << 19
UNKNOWN = "und"
#: Training: weight of errors, passes over the sample, steepness of margins as chances.
COST, PASSES, STEEPNESS = 10.0, 30, 3.0

#: Letters that the beginnings of labelled texts have, about. A text is held against the longest that it reaches.
BEGINNINGS = (4, 16, 64, 256, 1024)
#: A text is foreign if it lies this many times as far below the median as the ``TAIL`` quantile of labelled texts.
SPREAD, TAIL = 1.5, 0.01
#: Share of the even distribution in the likelihoods.
EVEN = 0.01
#: Profiles that are handled at once on the driver.
ROWS = 500

#: Bytes that are no letters count as one: a space.
PLAIN = np.array([b if b > 127 or 97 <= b <= 122 else 32 for b in range(256)], np.uint64)


# --- profiles -----------------------------------------------------------------------------


def gram_counts(data: np.ndarray, owner: np.ndarray, rows: int, starts: int) -> np.ndarray:
    """Counts (rows x ``SIZE``) of the n-grams that begin in the first ``starts`` bytes, within one row each."""
    out = np.zeros(rows * SIZE)
    key = np.zeros(len(data), np.uint64)
    for n in range(1, GRAMS + 1):
        length = len(data) - n + 1
        if length <= 0:
            break
        key = (key[:length] << np.uint64(8)) | data[n - 1 : n - 1 + length]
        inside = np.flatnonzero(owner[:length] == owner[n - 1 : n - 1 + length])
        inside = inside[inside < starts]
        place = (mix(key[inside] + np.uint64(n << 40)) & np.uint64(SIZE - 1)).astype(np.int64)
        out += np.bincount(owner[inside] * SIZE + place, minlength=rows * SIZE)
    return out.reshape(rows, SIZE)


def profiles(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, profiles) of consecutive rows; long texts are counted in slices."""
    data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    row, rows = 0, len(texts)
    while row < rows:
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
        last = min(max(last, row + 1), rows)
        part = data[offsets[row] : offsets[last]]
        if last == row + 1:
            counts = np.zeros((1, SIZE))
            for at in range(0, len(part), BLOCK):
                window = PLAIN[part[at : at + BLOCK + GRAMS - 1]]
                counts += gram_counts(window, np.zeros(len(window), np.int64), 1, BLOCK)
        else:
            owner = np.repeat(np.arange(last - row), np.diff(offsets[row : last + 1]))
            counts = gram_counts(PLAIN[part], owner, last - row, len(part))
        total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
        yield row, np.sqrt(counts / total).astype(np.float32)
        row = last


# --- training -----------------------------------------------------------------------------


def machine(x: np.ndarray, positive: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights (the last one is the offset) of a linear support vector machine, by dual coordinate descent."""
    y = np.where(positive, 1.0, -1.0)
    # Either side has the same weight, however many documents it has.
    cost = COST * len(y) / (2 * np.where(positive, positive.sum(), (~positive).sum()))
    norm = np.einsum("ij,ij->i", x, x) + 1
    alpha, w, offset = np.zeros(len(y)), np.zeros(x.shape[1]), 0.0
    order = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in order.permutation(len(y)):
            step = np.clip(alpha[i] + (1 - y[i] * (x[i] @ w + offset)) / norm[i], 0, cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                offset += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.r_[w, offset].astype(np.float32)


@dataclass
class Model:
    """Families (lists of languages), a machine per family, and per family a machine per pair."""

    families: list[list[str]] = field(default_factory=list)
    family_weights: np.ndarray | None = None
    pairs: list[dict[tuple[int, int], np.ndarray]] = field(default_factory=list)
    #: By language: log likelihoods of n-grams, and the least (margin, likelihood) per length of ``BEGINNINGS``.
    likelihoods: dict[str, np.ndarray] = field(default_factory=dict)
    least: dict[str, np.ndarray] = field(default_factory=dict)

    def evidence(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        """Margin and likelihood (rows x 2) of each profile for its language."""
        label, out = np.array(names, object), np.zeros((len(x), 2))
        wide = np.hstack([x, np.ones((len(x), 1), np.float32)])
        for f, languages in enumerate(self.families):
            for k, language in enumerate(languages):
                rows = np.flatnonzero(label == language)
                margins = [wide[rows] @ self.family_weights[f]] if len(self.families) > 1 else []
                for (a, b), weights in self.pairs[f].items():
                    if k in (a, b):
                        margins.append((wide[rows] @ weights) * (1 if k == a else -1))
                out[rows, 0] = np.min(margins, axis=0) if margins else 0.0
                out[rows, 1] = (x[rows] * x[rows]) @ self.likelihoods[language]
        return out

    def told(self, x: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """Whether each profile, of a text with so many letters, is in the language that is predicted for it."""
        names, _ = self.predict(x)
        step = np.maximum(np.searchsorted(BEGINNINGS, letters, side="right") - 1, 0)
        known = np.array([name in self.least for name in names], bool)
        least = np.array([self.least[name][k] if ok else (0.0, 0.0) for name, k, ok in zip(names, step, known)]).reshape(-1, 2)
        return known & (self.evidence(x, names) >= least).all(axis=1)

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each profile."""
        if not self.families:
            return [UNKNOWN] * len(x), np.zeros(len(x))
        x = np.hstack([x, np.ones((len(x), 1), np.float32)])
        if len(self.families) > 1:
            margins = x @ self.family_weights.T
            family = margins.argmax(axis=1)
            chances = 1 / (1 + np.exp(-STEEPNESS * margins))
            score = chances.max(axis=1) / np.maximum(chances.sum(axis=1), 1e-9)
        else:
            family, score = np.zeros(len(x), np.int64), np.ones(len(x))
        names = np.empty(len(x), object)
        for f, languages in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            votes, support = np.zeros((len(rows), len(languages))), np.zeros((len(rows), len(languages)))
            for (a, b), weights in self.pairs[f].items():
                chance = 1 / (1 + np.exp(-STEEPNESS * (x[rows] @ weights)))
                votes[:, a] += chance >= 0.5
                votes[:, b] += chance < 0.5
                support[:, a] += chance
                support[:, b] += 1 - chance
            best = (votes + support / (len(languages) + 1)).argmax(axis=1)
            names[rows] = np.array(languages, object)[best]
            if len(languages) > 1:
                score[rows] *= support[np.arange(len(rows)), best] / (len(languages) - 1)
        return names.tolist(), np.clip(score, 0, 1)


def grouped(languages: list[str], means: np.ndarray) -> list[list[str]]:
    """Families of languages by likeness of their mean profiles (average linkage)."""
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)
    # The mean over languages is what all share; families show in what is left.
    unit = unit - unit.mean(axis=0)
    likeness = unit @ unit.T
    groups = [[k] for k in range(len(languages))]
    while len(groups) > ceil(sqrt(len(languages))):
        pairs = [(likeness[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j]
        _, i, j = max(pairs)
        groups[i] = groups[i] + groups.pop(j)
    return [[languages[k] for k in sorted(g)] for g in groups]


def trained(x: np.ndarray, names: list[str], families: list[list[str]] | None = None) -> Model:
    languages = sorted(set(names))
    if not languages:
        return Model()
    label = np.array(names, object)
    if families is None:
        families = grouped(languages, np.stack([x[label == k].mean(axis=0) for k in languages]))
    families = [known for f in families if (known := [k for k in f if k in languages])]
    member = {language: f for f, group in enumerate(families) for language in group}
    inside = np.array([member.get(k, -1) for k in names])
    model = Model(families)
    if len(families) > 1:
        if (inside < 0).any():
            x, label, inside = x[inside >= 0], label[inside >= 0], inside[inside >= 0]
        model.family_weights = np.stack([machine(x, inside == f) for f in range(len(families))])
    for group in families:
        machines = {}
        for a in range(len(group)):
            for b in range(a + 1, len(group)):
                rows = (label == group[a]) | (label == group[b])
                machines[(a, b)] = machine(x[rows], label[rows] == group[a])
        model.pairs.append(machines)
    return model


def letter_counts(texts: pa.Array) -> np.ndarray:
    """Letters of each text; bytes beyond ASCII count as one each."""
    data, offsets = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    return np.diff(np.r_[0, np.cumsum(PLAIN[data] != 32)][offsets])


def calibrate(model: Model, x: np.ndarray, names: list[str], beginnings: pa.Array) -> None:
    """Learn likelihoods, and how low margin and likelihood get where the model is right, from labelled texts."""
    label = np.array(names, object)
    for language in sorted(set(names)):
        mean = np.square(x[label == language]).mean(axis=0, dtype=np.float64)
        model.likelihoods[language] = np.log((1 - EVEN) * SIZE * mean + EVEN)
    found: dict[str, list[np.ndarray]] = {language: [] for language in model.likelihoods}
    for length in BEGINNINGS:
        seen = {language: [] for language in found}
        for at in range(0, len(names), ROWS):
            texts = pc.utf8_slice_codeunits(beginnings.slice(at, ROWS), 0, length)
            enough = letter_counts(texts) > 0
            own = label[at : at + ROWS]
            for first, part in profiles(texts):
                rows = slice(first, first + len(part))
                right = (np.array(model.predict(part)[0], object) == own[rows]) & enough[rows]
                for name, value in zip(own[rows][right], model.evidence(part[right], own[rows][right].tolist())):
                    seen[name].append(value)
        for language, values in seen.items():
            if values:
                middle, low = np.median(values, axis=0), np.quantile(values, TAIL, axis=0)
                found[language].append(middle - SPREAD * (middle - low) - 1e-9)
            else:
                found[language].append(np.full(2, -np.inf))
    model.least = {language: np.stack(steps) for language, steps in found.items()}


def learn(
    docs: DataFrame, train: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", foreign: bool = False
) -> Model:
    """Model from texts and languages of the rows that ``train`` chooses; with ``foreign``, ``in_language`` can use it.

    The sample takes up to ``SAMPLE / languages`` documents of each of the ``LANGUAGES`` languages with
    most documents (ties: smaller name), by the hash of their id: ``SAMPLE`` rows at most, unless rows
    share an id. Rows without language, id or letters are left out; other columns don't matter. An empty
    table gives a model that knows no language.
    """
    usable = docs.filter(train).select(
        F.col(f"`{doc_id}`").alias("sample_id"), F.col(f"`{lang}`").alias("sample_lang"), F.col(f"`{text}`").alias("sample_text")
    )
    usable = usable.filter("sample_lang IS NOT NULL AND sample_id IS NOT NULL")
    counts = usable.groupBy("sample_lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "sample_lang").limit(LANGUAGES)
    rows_of = {r["sample_lang"]: r["rows"] for r in counts.collect()}
    if not rows_of:
        return Model()
    each = max(1, SAMPLE // len(rows_of))
    # The smallest hashes of a language lie far below this bound, so few ids of a common one are ranked.
    share = F.create_map(*[F.lit(x) for lang, rows in rows_of.items() for x in (lang, min(1.0, 4 * each / rows))])
    hashed = usable.select("sample_id", "sample_lang", F.xxhash64("sample_id").bitwiseAND(F.lit(HASHES - 1)).alias("hash"))
    hashed = hashed.filter(F.col("hash") < share[F.col("sample_lang")] * float(HASHES))
    turn = F.row_number().over(Window.partitionBy("sample_lang").orderBy("hash", "sample_id"))
    chosen = hashed.withColumn("turn", turn).filter(F.col("turn") <= each).select("sample_id", "sample_lang").distinct()
    # At most SAMPLE ids: small enough to broadcast.
    rows = usable.filter(has_letter(F.col("sample_text"))).join(F.broadcast(chosen), ["sample_id", "sample_lang"], "left_semi")

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, x in profiles(batch.column(1)):
                row, place = np.nonzero(x)
                offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=len(x)))].astype(np.int32)
                places = pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[row, place]))
                begins = pc.utf8_slice_codeunits(batch.column(1).slice(first, len(x)), 0, BEGINNINGS[-1])
                columns = [batch.column(0).slice(first, len(x)), places, values, begins]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "places", "weights", "begins"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [batch for batch in batches if len(batch)]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        names = np.array(table["lang"].to_pylist(), object)
        places, sizes = table["places"].combine_chunks(), table["places"].combine_chunks().value_lengths().to_numpy()
        x = np.zeros((len(names), SIZE), np.float32)
        x[np.repeat(np.arange(len(names)), sizes), places.flatten().to_numpy()] = table["weights"].combine_chunks().flatten().to_numpy()
        # One order for any distribution of the rows over tasks.
        order = np.lexsort((x.sum(axis=1), names.astype(str)))
        begins = table["begins"].combine_chunks().take(pa.array(order))
        del table, parts, places
        x, names = x[order], names[order].tolist()
        model = trained(x, names)
        if foreign:
            calibrate(model, x, names, begins)
        # The parts, not the object: a task may have its class from another import of this module.
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(list(vars(model).values()))], pa.binary())], names=["model"])

    narrow = rows.select(F.col("sample_lang").cast("string").alias("lang"), F.col("sample_text").alias("text"))
    ddl = "lang string, places array<int>, weights array<float>, begins string"
    sample = kept(narrow.mapInArrow(profile, ddl), "language-sample")
    found = sample.coalesce(1).mapInArrow(fit, "model binary").collect()
    return Model(*pickle.loads(found[0]["model"])) if found else Model()


# --- prediction ---------------------------------------------------------------------------

PREDICTION = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predicted(docs: DataFrame, model: Model, *, text: str = "text", name: str = "language") -> DataFrame:
    """All columns of ``docs`` and a struct ``name`` of ``lang_pred`` and ``score`` (0 to 1).

    - A text that is null or has no letter is ``und`` with score 0; so is every text if the
      model knows no language.
    - Rows are predicted one by one from their whole text, so ties, repeated rows and null
      ids change nothing. An empty table gives an empty table. A column called ``name`` is replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = [], []
            for _, x in profiles(batch):
                found, score = sent.value.predict(x)
                names += found
                scores.append(score)
            values = np.concatenate([*scores, np.zeros(0)])
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], names=PREDICTION.names)

    letters = has_letter(F.col(text))
    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return docs.withColumn(name, F.when(letters, predict(F.col(text))).otherwise(none))


def in_language(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text is in the language that is predicted for it.

    - Gibberish, mixtures and languages that the model does not know lie below the margins or
      likelihoods of labelled texts; short texts are held against short beginnings of these.
    - A text that is null or has no letter is left out; so is every text if the model knows no
      language. Rows are judged one by one. The model is learned with ``foreign``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.BooleanType())
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            letters = letter_counts(batch)
            parts = [sent.value.told(x, letters[first : first + len(x)]) for first, x in profiles(batch)]
            yield pa.array(np.concatenate([*parts, np.zeros(0, bool)]).astype(bool), pa.bool_())

    return docs.filter(has_letter(F.col(text))).filter(told(F.col(text)))
