"""Quality of texts: random-indexing word vectors, pooled per text, and a small calibrated network."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shrinkwise.llm.common import fields, map_batches
from shrinkwise.llm.learning import labelled_sample, sigmoid
from shrinkwise.session import saved_table

#: Labelled files of each label from which vectors and network are learned, at most.
SAMPLE_ROWS = 4000
#: Dimensions of the word vectors, and entries of an index vector that are not zero.
DIMENSIONS = 96
NONZERO = 6
#: Words with vectors of their own at most; others share the vector of their form.
VOCABULARY = 8_000
#: Forms with vectors at most, the most frequent ones, and the characters of a form; longer forms share its beginning.
FORMS = 16_000
FORM_CHARS = 12
#: Words before and after a word that make its context.
REACH = 2
HIDDEN = 24
ROUNDS = 400
DECAY = 5e-3
#: Share of the sample kept for the temperature.
CALIBRATION = 5
REMEMBERED_WORDS = 1 << 18
SEED = 7

_WORD = regex.compile(r"\S+")
_LETTERS, _DIGITS = regex.compile(r"\p{Ll}+|\p{Lu}\p{Ll}+"), regex.compile(r"\p{N}+")
_CAPITALS = regex.compile(r"\p{Lu}+")


def score_quality(
    files: DataFrame, labels: DataFrame, rel_path: str = "rel_path", text: str = "text", quality: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """Quality of every file's text from 0 to 1: (rel_path, score), a row per input row.

    `labels` (rel_path, quality) are the labels to learn from, 1 for good; scores depend on the text only. Every
    word has a sparse random index vector, made from its hash; over at most `sample_rows` files of each label,
    a word's vector is the sum of the index vectors around it (random indexing), and so is the vector of
    its form: capitals, letters and digits by kind, signs as they are. Words beyond the vocabulary use their
    form's. A text's features are the mean of its words' vectors and of their forms', and a few shares:
    repeated words and lines, capitals, signs, and its length. A network of two layers is fitted on
    four fifths of the sample, and a temperature on the rest makes its outputs probabilities.

    Null and empty texts are scored as texts without words. Without labels of both kinds the score is the share
    of good labels, 0 if there is none. Rows that share a rel_path are scored each by its own text. Other
    columns are ignored. No rows give no rows.
    """
    sample = labelled_sample(files, labels, rel_path, text, quality, sample_rows)
    kinds = {r[0] for r in sample.select("label").distinct().collect()}
    schema = fields(files, [rel_path], "score double")
    if len(kinds) < 2:
        return files.select(rel_path).withColumn("score", F.lit(float(max(kinds, default=0))))
    vectors = word_vectors(sample)
    network = _fit(sample, vectors)
    shipped = files.sparkSession.sparkContext.broadcast(vectors)

    def run(batch: pa.RecordBatch, pool: Pool) -> dict[str, object]:
        x = np.stack([pool.features(t or "") for t in batch.column(1).to_pylist()])
        return {rel_path: batch.column(0), "score": network.probability(x)}

    return map_batches(files.select(rel_path, text), run, schema, lambda: Pool(shipped.value))


def index_vector(word: str) -> np.ndarray:
    """Sparse random vector of a word: a few entries of 1 or -1 at places that its hash gives."""
    vector = np.zeros(DIMENSIONS)
    for i in range(NONZERO):
        h = xxhash.xxh64_intdigest(word.encode(), i)
        vector[h % DIMENSIONS] += 1 if h >> 63 else -1
    return vector


def form(word: str) -> str:
    """Kinds of characters in their order, each run once; signs as they are."""
    word = _LETTERS.sub("a", word)
    return "~" + _DIGITS.sub("0", _CAPITALS.sub("A", word))[:FORM_CHARS]


def word_vectors(sample: DataFrame) -> dict[str, np.ndarray]:
    """Vectors of the most frequent words of the sample, and of their forms.

    Workers count neighbours of words in their texts; Spark adds the counts up. Contexts are the words around a
    word, by their form if they are rare. The words are bounded by VOCABULARY and the forms by FORMS, whatever the texts.
    """
    words = sample.select(F.explode(F.split("text", r"\s+")).alias("word")).where("word != ''")
    ranked = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(VOCABULARY)
    known = frozenset(r[0] for r in ranked.where("count >= 5").collect())

    def run(batch: pa.RecordBatch) -> dict[str, object]:
        places: dict[str, int] = {}
        texts = []
        for text in batch.column(0).to_pylist():
            words = _WORD.findall(text)
            forms = [form(w) for w in words]
            names = [w if w in known else f for w, f in zip(words, forms, strict=True)]
            texts.append([np.array([places.setdefault(w, len(places)) for w in own], np.int64) for own in (names, forms)])
        index = np.array([index_vector(w) for w in places]).reshape(-1, DIMENSIONS)
        totals, as_form = np.zeros_like(index), np.zeros(len(index), np.int64)
        for names, forms in texts:
            around = np.zeros((len(names), DIMENSIONS))
            for k in range(1, min(REACH, len(names) - 1) + 1):
                around[:-k] += index[names[k:]]
                around[k:] += index[names[:-k]]
            for own in (names, forms):
                add_rows(totals, own, around)
            as_form += np.bincount(forms, minlength=len(index))
        return {"word": list(places), "own": [w in known for w in places], "n": as_form, "vector": totals.tolist()}

    parts = map_batches(sample.select("text").repartition(8), run, fields(sample, [], "word string, own boolean, n bigint, vector array<double>"))
    sums = parts.groupBy("word").agg(F.max("own").alias("own"), F.sum("n").alias("n"), *[F.sum(F.col("vector")[i]).alias(f"v{i}") for i in range(DIMENSIONS)])
    sums = saved_table(sums, "vectors")
    kept = sums.where("own").unionByName(sums.where("not own").orderBy(F.desc("n"), "word").limit(FORMS)).drop("own", "n")
    out = {}
    for row in kept.orderBy("word").collect():
        vector = np.array(row[1:])
        out[row[0]] = (vector / max(np.linalg.norm(vector), 1e-9) + 0.5 * index_vector(row[0])).astype(np.float32)
    return out


def add_rows(totals: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the total at its place; places may repeat."""
    if len(places):
        order = np.argsort(places, kind="stable")
        ordered = places[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        totals[ordered[starts]] += np.add.reduceat(rows[order], starts)


class Pool:
    """Features of texts from word vectors; every distinct word is looked up once and remembered."""

    def __init__(self, vectors: dict[str, np.ndarray]):
        self.places = {w: i for i, w in enumerate(vectors)}
        self.table = np.vstack([*vectors.values(), np.zeros((1, DIMENSIONS), np.float32)])
        self.known: dict[str, tuple[int, int]] = {}

    def place(self, word: str) -> tuple[int, int]:
        """Rows of a word's vector and of its form's; the last row, of zeros, for a form never seen."""
        shared = self.places.get(form(word), len(self.places))
        found = self.known[word] = self.places.get(word, shared), shared
        return found

    def features(self, text: str) -> np.ndarray:
        counts = Counter(_WORD.findall(text))
        if len(self.known) > REMEMBERED_WORDS:
            self.known.clear()
        total, pooled = sum(counts.values()), np.zeros(2 * DIMENSIONS, np.float32)
        if total:
            places = np.array([self.known.get(w) or self.place(w) for w in counts])
            share = np.fromiter(counts.values(), np.float32, len(counts)) / total
            pooled = np.concatenate([share @ self.table[places[:, 0]], share @ self.table[places[:, 1]]])
        return np.concatenate([pooled, shares(text, counts, total)])


def shares(text: str, counts: Counter[str], total: int) -> np.ndarray:
    """How much of a text repeats, is in capitals or is signs, and how long it is."""
    lines = [line for line in text.split("\n") if line]
    letters = sum(map(len, _LETTERS.findall(text)))
    capitals = sum(map(len, _CAPITALS.findall(text)))
    size = max(1, len(text))
    most = max(counts.values(), default=0) / max(1, total)
    out = [len(counts) / max(1, total), most, len(set(lines)) / max(1, len(lines)), letters / size, capitals / size, np.log1p(total) / 5, np.log1p(total / max(1, len(lines))) / 5]
    return np.array(out, np.float32)


class Network:
    """Two layers: tanh units and a logistic output; probabilities are divided by a temperature in the exponent."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.default_rng(SEED)
        self.layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self._descend(x, y, weight / weight.mean())

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.tanh((x - self.mean) / self.scale @ w + b) @ v + c

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature)

    def _descend(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Adam over random batches, with a small decay of the weights."""
        x = (x - self.mean) / self.scale
        rng = np.random.default_rng(SEED)
        first, second = ([np.zeros_like(p) for p in self.layers] for _ in range(2))
        for t in range(1, ROUNDS * 10 + 1):
            at = rng.integers(0, len(x), 128)
            w, b, v, c = self.layers
            h = np.tanh(x[at] @ w + b)
            d = weight[at] * (sigmoid(h @ v + c) - y[at]) / len(at)
            dh = d[:, None] * v * (1 - h * h)
            grads = [x[at].T @ dh + DECAY * w, dh.sum(axis=0), h.T @ d + DECAY * v, np.array([d.sum()])]
            rate = 3e-3 * min(1.0, 2 - 2 * t / (ROUNDS * 10))
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                self.layers[i] = self.layers[i] - rate * first[i] / (1 - 0.9**t) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """The temperature with the least weighted log loss."""
        logits = self.logits(x)

        def loss(t: float) -> float:
            p = np.clip(sigmoid(logits / t), 1e-9, 1 - 1e-9)
            return float(-(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())

        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))


def _fit(sample: DataFrame, vectors: dict[str, np.ndarray]) -> Network:
    shipped = sample.sparkSession.sparkContext.broadcast(vectors)

    def run(batch: pa.RecordBatch, pool: Pool) -> dict[str, object]:
        return {"x": [pool.features(t).tolist() for t in batch.column(0).to_pylist()], "label": batch.column(1), "weight": batch.column(2), "fold": batch.column(3)}

    fold = F.pmod(F.xxhash64("text"), F.lit(CALIBRATION)).alias("fold")
    rows = sample.select("text", "label", "weight", fold)
    rows = map_batches(rows, run, fields(rows, [], "x array<float>, label int, weight double, fold bigint"), lambda: Pool(shipped.value))
    x, y, weight, fold = (np.array(c) for c in zip(*rows.collect(), strict=True))
    kept = fold > 0
    if len(set(y[kept])) < 2:
        kept = np.ones(len(y), bool)
    network = Network(x[kept], y[kept], weight[kept])
    if (~kept).sum() and len(set(y[~kept])) == 2:
        network.calibrate(x[~kept], y[~kept], weight[~kept])
    return network
