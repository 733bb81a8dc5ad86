"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of hashed vectors: of the word and of its first four,
five and six characters, so that endings never met still count.  Filters of widths
one to three run over the words of a text, max pooling keeps each filter's strongest
answer, and a logistic layer gives the score.  The vectors start from how much more
often a feature is met in toxic texts; training by Adam moves all weights, and the
gradient flows through the pooled places only.

A threshold for each language is chosen on rows that were not trained on.  The
language is guessed from the text's own function words; a score is then rescaled so
that its language's threshold comes to lie at ``CUT``.
"""

from __future__ import annotations

import pickle
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docgraph.llm.common import Numbering, text_parts

WORDS = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6)
DIMENSIONS = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
CUT = 0.3
#: Bounds of the labelled rows that one task fits the model on: how many, and the bytes of all their texts.
SAMPLE_ROWS = 6_000
SAMPLE_BYTES = 64 << 20
#: A feature is kept if it is met in so many sampled texts.
LEAST_TEXTS = 2
FUNCTION_WORDS = {
    "en": "the of and to in that is for with was".split(), "fr": "le les des et du une dans est que pour".split(),
    "de": "der die und das den von mit ist nicht ein".split(), "es": "el los de que y las una por con para".split(),
}
LANGUAGES = (*FUNCTION_WORDS, "other")


NO_FEATURE = -1


def hashed_features(words: list[str]) -> np.ndarray:
    """A row for each word: the hashes of the word and of its beginnings, ``NO_FEATURE`` for those it is too short for."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    columns = [hash32(["w" + w for w in words])]
    for n in PREFIXES:
        columns.append(np.where(lengths >= n, hash32([f"{n}{w[:n]}" for w in words]), NO_FEATURE))
    return np.column_stack(columns)


def hash32(strings: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh32_digest, strings)), ">u4").astype(np.int64)


def numbered(texts: list[str]) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Distinct words, each text as numbers of them, and the languages guessed by the most function words."""
    place = Numbering()
    rows = []
    for text in texts:
        words = WORDS.findall(text.lower())
        rows.append(np.fromiter(map(place.__getitem__, words), np.int64, len(words)))
    votes = np.zeros((len(texts), len(LANGUAGES)), np.int64)
    says = np.zeros((len(place), len(FUNCTION_WORDS)), np.int64)
    for k, known in enumerate(FUNCTION_WORDS.values()):
        says[[place[w] for w in known if w in place], k] = 1
    for i, row in enumerate(rows):
        if len(row):
            votes[i, :-1] = says[row].sum(0)
    return list(place), rows, np.where(votes.any(1), votes.argmax(1), len(LANGUAGES) - 1)


@dataclass
class Cnn:
    keys: np.ndarray  # hashes of the known features, ascending
    vectors: np.ndarray  # (known features + 1, DIMENSIONS); the last row is zero, for all others
    kernels: list[np.ndarray]  # by width: (width, DIMENSIONS, FILTERS)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray  # by language

    def feature_rows(self, words: list[str]) -> np.ndarray:
        """Rows of ``vectors`` for each word, four of them."""
        hashes = hashed_features(words)
        if not len(self.keys):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def pooled(self, embedded: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Strongest answer of each filter in each text, its place among all words, and the padded words.

        Texts lie in one row with two blank words between them; answers below zero are zero.
        """
        blank = len(embedded)
        table = np.vstack([embedded, np.zeros((1, DIMENSIONS), np.float32)])
        gap = np.full(max(WIDTHS), blank)
        line = np.concatenate([x for r in rows for x in (r, gap)]) if rows else np.zeros(0, np.int64)
        sizes = np.array([len(r) + len(gap) for r in rows])
        starts = np.cumsum(sizes) - sizes
        best, places = [], []
        for width, kernel, bias in zip(WIDTHS, self.kernels, self.biases):
            answers = np.tile(bias.astype(np.float32), (len(line), 1))
            for j in range(width):
                part = table @ kernel[j].astype(np.float32)
                answers[: len(line) - j] += part[line[j:]]
            top = np.maximum.reduceat(answers, starts, axis=0) if len(rows) else np.zeros((0, FILTERS))
            best.append(np.maximum(top, 0.0))
            places.append((answers, starts, sizes, top))
        return np.hstack(best), places, line

    def odds(self, words: list[str], rows: list[np.ndarray]) -> np.ndarray:
        embedded = self.vectors[self.feature_rows(words)].sum(1).astype(np.float32) if words else np.zeros((0, DIMENSIONS), np.float32)
        best, _, _ = self.pooled(embedded, rows)
        return best @ self.weights + self.bias

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated scores and guessed languages."""
        words, rows, languages = numbered(texts)
        return 1 / (1 + np.exp(-np.clip(self.odds(words, rows), -30, 30))), languages

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated scores, each language's threshold lying at CUT, and guessed languages."""
        raw, languages = self.raw(texts)
        t = self.thresholds[languages]
        return np.where(raw < t, CUT * raw / t, CUT + (1 - CUT) * (raw - t) / (1 - t)), languages


def initial(words: list[str], rows: list[np.ndarray], labels: np.ndarray, seed: int) -> Cnn:
    rng = np.random.default_rng(seed)
    of_word = hashed_features(words)
    all_keys, number = np.unique(of_word, return_inverse=True)
    number = number.reshape(of_word.shape)
    counts = np.zeros((len(all_keys), 2), np.int64)
    for row, label in zip(rows, labels.tolist()):
        counts[np.unique(number[np.unique(row)]), label] += 1
    kept = (counts.sum(1) >= LEAST_TEXTS) & (all_keys != NO_FEATURE)
    keys, pairs = all_keys[kept], counts[kept].astype(np.float64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    prior = 5.0
    mean = (pairs[:, 1] + prior * share) / (pairs.sum(1) + prior)
    vectors = np.zeros((len(keys) + 1, DIMENSIONS))
    vectors[:-1] = rng.normal(0, 0.02, (len(keys), DIMENSIONS))
    vectors[:-1, 0] = np.clip(np.log(mean / (1 - mean)) - np.log(share / (1 - share)), -1, 6) / 4
    kernels, biases = [], []
    for width in WIDTHS:
        kernel = rng.normal(0, 0.1, (width, DIMENSIONS, FILTERS))
        kernel[0, 0] = np.abs(kernel[0, 0]) + 1 / np.sqrt(width)
        kernels.append(kernel)
        biases.append(np.full(FILTERS, -0.5))
    return Cnn(keys, vectors, kernels, biases, np.full(FILTERS * len(WIDTHS), 0.2), -2.0, np.full(len(LANGUAGES), CUT))


def train(texts: list[str], labels: np.ndarray, seed: int = 5, epochs: int = 4, batch: int = 64, rate: float = 0.01, held: float = 0.2) -> Cnn:
    """The classifier; the last ``held`` of the texts choose the thresholds. Without both labels every score is low."""
    words, rows, languages = numbered(texts)
    labels = np.asarray(labels, np.int64)
    cut = len(texts) - int(held * len(texts))
    model = initial(words, rows[:cut], labels[:cut], seed)
    features = model.feature_rows(words)
    parameters = [model.vectors, *model.kernels, *model.biases, model.weights]
    bias = np.array([model.bias])
    parameters.append(bias)
    first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    rng, step = np.random.default_rng(seed), 0
    if not labels[:cut].any() or labels[:cut].all():
        epochs = 0
    for _ in range(epochs):
        order = rng.permutation(cut)
        for i in range(0, cut, batch):
            chosen = order[i : i + batch]
            slopes = gradients(model, bias, features, [rows[c] for c in chosen], labels[chosen])
            step += 1
            for p, g, m, v in zip(parameters, slopes, first, second):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            model.vectors[-1] = 0
            model.bias = float(bias[0])
    embedded = model.vectors[features].sum(1).astype(np.float32) if words else np.zeros((0, DIMENSIONS), np.float32)
    odds = [model.pooled(embedded, rows[i : i + batch])[0] @ model.weights + model.bias for i in range(cut, len(rows), batch)]
    raw = 1 / (1 + np.exp(-np.clip(np.concatenate(odds) if odds else np.zeros(0), -30, 30)))
    overall = best_threshold(raw, labels[cut:], 0.5)
    model.thresholds = np.array([best_threshold(raw[languages[cut:] == k], labels[cut:][languages[cut:] == k], overall) for k in range(len(LANGUAGES))])
    return model


def gradients(model: Cnn, bias: np.ndarray, features: np.ndarray, rows: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss, for the parameters in the order in which ``train`` lists them."""
    used, line = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.int64), return_inverse=True)
    local = np.split(line, np.cumsum([len(r) for r in rows])[:-1])
    of_used = features[used]
    embedded = model.vectors[of_used].sum(1).astype(np.float32).reshape(len(used), DIMENSIONS)
    best, places, line = model.pooled(embedded, local)
    table = np.vstack([embedded, np.zeros((1, DIMENSIONS))])
    odds = best @ model.weights + bias[0]
    gap = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels) / len(labels)
    slope_best = gap[:, None] * model.weights[None, :] * (best > 0)
    slope_words = np.zeros((len(used) + 1, DIMENSIONS))
    slope_kernels, slope_biases = [], []
    for k, (width, kernel, (answers, starts, sizes, top)) in enumerate(zip(WIDTHS, model.kernels, places)):
        part = slope_best[:, k * FILTERS : (k + 1) * FILTERS]
        slope_biases.append(part.sum(0))
        slope_kernel = np.zeros_like(kernel)
        for t, f in zip(*np.nonzero(part)):
            at = starts[t] + int(answers[starts[t] : starts[t] + sizes[t], f].argmax())
            for j in range(width):
                if at + j < len(line):
                    slope_kernel[j, :, f] += part[t, f] * table[line[at + j]]
                    slope_words[line[at + j]] += part[t, f] * kernel[j, :, f]
        slope_kernels.append(slope_kernel)
    slope_vectors = np.zeros_like(model.vectors)
    np.add.at(slope_vectors, of_used, np.repeat(slope_words[: len(used), None, :], features.shape[1], 1))
    return [slope_vectors, *slope_kernels, *slope_biases, best.T @ gap, np.array([gap.sum()])]


def best_threshold(scores: np.ndarray, labels: np.ndarray, other: float) -> float:
    """The threshold with the best F1, in the middle of its gap; ``other`` where there are too few rows to tell."""
    if labels.sum() < 5 or (1 - labels).sum() < 5:
        return other
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(1, len(scores) + 1) + labels.sum())
    s = scores[order]
    last = np.append(s[1:] < s[:-1], True)
    at = int(np.where(last, f1, -1).argmax())
    below = s[at + 1] if at + 1 < len(s) else 0.0
    return float(np.clip((s[at] + below) / 2, 0.02, 0.98))


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, seed: int = 5) -> Cnn:
    """Fits on at most ``sample_rows`` rows with a label, those with the smallest hash of their text.

    Rows are taken whole until their texts come to ``sample_bytes``.  One task trains on this
    bounded sample, so neither texts nor training pass through the driver, which gets the weights only.
    Rows without a label are not used; a null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = labelled.where(F.col(label_col).isNotNull()).select(text.alias("text"), F.col(label_col).cast("int").alias("label"), F.xxhash64(F.lit(seed), text).alias("h"))
    order = ["h", "label", "text"]
    sample = rows.orderBy(*order).limit(sample_rows)
    so_far = F.sum(F.octet_length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # of a bounded sample
    sample = sample.select("*", so_far.alias("bytes")).where(F.col("bytes") <= sample_bytes)

    def run(batches):
        texts, labels = [], []
        for batch in batches:
            texts += batch["text"].to_pylist()
            labels += batch["label"].to_pylist()
        model = train(texts, np.array(labels, np.int64) > 0, seed)
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # One partition, the bounded sample: an empty one gives a model too.
    trained = sample.select("text", "label").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(trained[0]["model"]) if trained else train([], np.zeros(0, np.int64), seed)


#: Bytes scored together.
BATCH_BYTES = 1_000_000


def score(docs: DataFrame, model: Cnn, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``score`` in [0, 1], ``predicted`` and the guessed ``language``.

    Null and empty texts get the score of a text without words.  Each row is scored
    by its text alone: repeated rows agree, null ids stay, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the features of SAMPLE_ROWS texts

    def run(batches):
        cnn = shared.value
        for batch in batches:
            for ids, texts in text_parts(batch, BATCH_BYTES):
                scores, languages = cnn.scores(texts)
                yield pa.RecordBatch.from_pydict({"id": ids, "score": pa.array(scores), "predicted": pa.array((scores >= CUT).astype(np.int32)), "language": [LANGUAGES[k] for k in languages]})

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, "id long, score double, predicted int, language string").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Cnn:
    """Fitted on labelled rows that are not held out: the ``sample_rows`` ids with the smallest hash.

    The sample of labels is bounded, so it is sent to all tasks, and no text is shuffled to meet it.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("of")).agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("of"), "of").limit(sample_rows)
    texts = docs.select(F.col(id_col).alias("of"), F.col(text_col).alias("text"))
    return fit(texts.join(F.broadcast(known), "of"), sample_rows=sample_rows)


def without_toxic(docs: DataFrame, model: Cnn, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text the model does not call toxic, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cnn = shared.value
        for batch in batches:
            text = pc.struct_field(batch["row"], text_col)
            parts = text_parts(pa.RecordBatch.from_pydict({"id": pa.nulls(len(text)), "text": text}), BATCH_BYTES)
            at = 0
            for _, texts in parts:
                keep = cnn.scores(texts)[0] < CUT
                yield batch.slice(at, len(texts)).filter(pa.array(keep, pa.bool_()))
                at += len(texts)

    nested = docs.select(F.struct("*").alias("row"))
    schema = nested.schema
    return nested.mapInArrow(run, schema).select("row.*")
