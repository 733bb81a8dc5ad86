import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from docgraph.llm import toxicity as T

STEMS = {"en": ["grubble", "snarfid"], "de": ["kloppig"], "fr": ["zutaffe"]}


def made(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8)))
    texts, labels = [], []
    for _ in range(n):
        lang = rng.choice(list(STEMS))
        words = [rng.choice(T.FUNCTION_WORDS[lang]) if rng.random() < 0.3 else word() for _ in range(rng.randint(20, 150))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(STEMS[lang]) + rng.choice(["", "", word()])
        texts.append(" ".join(words).capitalize() + ".")
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_held_out_accuracy_also_with_new_endings():
    texts, labels = made(1_500, 1)
    model = T.train(texts, labels)
    new, truth = made(600, 2)
    scores, languages = model.scores([*new, ""])
    assert ((scores[:-1] >= T.CUT) == truth).mean() > 0.97
    assert 0 <= scores.min() and scores.max() <= 1 and scores[-1] < T.CUT
    assert {T.LANGUAGES[k] for k in languages} >= {"en", "de", "fr"}
    again = T.train(texts, labels).scores(new)[0]
    assert (again == scores[:-1]).all()


def test_gradients_equal_differences():
    texts, labels = made(12, 3)
    words, rows, _ = T.numbered(texts)
    model = T.initial(words, rows, labels, 1)
    bias = np.array([0.1])
    features = model.feature_rows(words)

    def loss():
        embedded = model.vectors[features].sum(1).astype(np.float32)
        odds = model.pooled(embedded, rows)[0] @ model.weights + bias[0]
        return np.mean(np.log1p(np.exp(odds)) - labels * odds)

    slopes = T.gradients(model, bias, features, rows, labels)
    for parameter, slope in zip([model.vectors, *model.kernels, *model.biases, model.weights, bias], slopes):
        at = np.unravel_index(np.abs(slope).argmax(), slope.shape)
        old = parameter[at]
        parameter[at] = old + 1e-3
        up = loss()
        parameter[at] = old - 1e-3
        down = loss()
        parameter[at] = old
        assert abs((up - down) / 2e-3 - slope[at]) < 0.02 * abs(slope[at]) + 2e-4


def test_one_class_or_no_labels_scores_low():
    for labels in (np.zeros(5, int), np.ones(5, int)):
        scores, _ = T.train(["some words here"] * 5, labels).scores(["some words", ""])
        assert ((scores >= 0) & (scores <= 1)).all()
    assert T.train([], np.zeros(0, int)).scores(["word"])[0][0] < T.CUT


def test_rows_and_split(docs, no_docs, spark):
    labels = spark.createDataFrame([(i * 3 + 1, 0, i % 2) for i in range(60)] + [(None, 1, 1), (4, 0, None)], "doc_id long, quality int, toxic int")
    model = T.classifier(docs, labels)
    found = T.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= T.CUT) for r in found)
    split = {r[0]: r[1] for r in spark.range(200).select("id", T.held_out("id")).collect()}
    assert split == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}
    kept = T.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] == 0 for r in found)
    assert T.score(no_docs, model).collect() == [] and T.without_toxic(no_docs, model).collect() == []
    assert T.classifier(docs, labels.where(F.lit(False))).scores(["x"])[0][0] < T.CUT
