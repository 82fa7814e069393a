"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's subwords are its byte n-grams (white space runs count as one blank, A-Z lower-cased),
hashed to buckets. Its features are the mean of the buckets' embeddings; a linear layer and
softmax give the languages. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled documents. For prediction the two linear maps are multiplied once, so a bucket
holds one score per language and a text's score is the mean over its subwords: the same result.

Calibration on documents kept out of training: a temperature that minimises the log loss, and the
score under which a prediction is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS, DIM, NGRAMS = 16, 16, (2, 3, 4)
#: labelled documents per language that training and calibration see at most
SAMPLE = 600
#: and all languages together
TOTAL = 120_000
_HASHES = 1 << 31
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
_BLOCK = 1 << 20


def subwords(data: bytes) -> Iterator[np.ndarray]:
    """Buckets of a text's n-grams, in blocks."""
    raw = _FOLD[np.frombuffer(b" " + data + b" ", np.uint8)]
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    b = raw[keep]
    for s in range(0, len(b), _BLOCK):
        part = b[s : s + _BLOCK + max(NGRAMS) - 1].astype(np.uint32)
        last = s + _BLOCK >= len(b)
        h = part
        for n in range(2, max(NGRAMS) + 1):
            h = (h[:-1] << np.uint32(8)) | part[n - 1 :]  # the last four bytes exactly
            if n in NGRAMS and len(h):
                own = h if last else h[:_BLOCK]
                yield ((own * _MIX[n - 2] + np.uint32(n)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKET_BITS)


def counts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for b in subwords(data):
        total += np.bincount(b, minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    """scores: one row per bucket, one column per language; a score under `least` is rejected."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, data: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for b in subwords(data):
            total += self.scores[b].sum(axis=0, dtype=np.float64)
            n += len(b)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score); UNKNOWN with score 0 for texts that are null or have no letter."""
        if not text or not _LETTER.search(text) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(text.encode()) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_lang: int, epochs: int = 12, rate: float = 0.5, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(scores, bias) by stochastic gradient descent, one document at a time in random order; languages weigh the same."""
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM))
    layer, bias = np.zeros((DIM, n_lang)), np.zeros(n_lang)
    weight = len(labels) / (n_lang * np.maximum(1, np.bincount(labels, minlength=n_lang)))
    steps, done = epochs * len(labels), 0
    for _ in range(epochs):
        for i in rng.permutation(len(labels)):
            at, n = examples[i]
            share = n / n.sum()
            mean = share @ table[at]
            error = softmax(mean @ layer + bias)
            error[labels[i]] -= 1
            step = rate * (1 - done / steps) * weight[labels[i]] * error
            back = layer @ step
            layer -= np.outer(mean, step)
            bias -= step
            table[at] -= len(at) ** 0.5 * share[:, None] * back  # rows are rare: larger steps
            done += 1
    return table @ layer, bias


def calibrate(logits: np.ndarray, labels: np.ndarray, keep: float) -> tuple[float, float]:
    """(temperature, least score): the temperature with the least log loss; the largest score that at least a share `keep` of the right predictions reach."""
    if not len(labels):
        return 1.0, 0.0
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(logits / t)
    right = p.argmax(axis=1) == labels
    # no interpolation: it would reject the lowest of a few; prediction adds up in another order, so a little less
    least = float(np.quantile(p.max(axis=1)[right], 1 - keep, method="lower")) - 1e-9 if right.any() else 0.0
    return t, least


def fold_of(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4; null ids are fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4, F.lit(0))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, sample: int = SAMPLE, keep: float = 0.999) -> Model:
    """Train on at most `sample` different labelled texts a language, those with the smallest hash; a fifth of them calibrates.

    Only documents outside the held-out fold are used, and only their text and label; every
    language among them is learned. The sample is the bound on what reaches the driver: as many
    as sample rows of counts a language, and at most TOTAL in all. `keep` is the share of right
    predictions that the rejection spares. Without any labelled document the model knows no language.
    """
    from pyspark.sql.window import Window

    rows = docs.filter((fold_of(F.col(id_col)) != held_out) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    own = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"), F.pmod(F.xxhash64(text_col), F.lit(_HASHES)).alias("u"))
    sizes = own.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy("lang").collect()  # a row a language
    langs = [r["lang"] for r in sizes]
    if not langs:
        return Model([], np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros(0))
    each = max(5, min(sample, TOTAL // len(langs)))
    # hashes under a language's cut are a few times the sample, so no task ranks a whole language
    cuts = docs.sparkSession.createDataFrame([(r["lang"], int(min(1.0, 4 * each / max(1, r["n"])) * _HASHES)) for r in sizes], "lang string, cut long")
    low = own.join(F.broadcast(cuts), "lang").filter(F.col("u") < F.col("cut")).select("lang", "h", "u").distinct()
    chosen = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))).filter(F.col("r") <= each).select("lang", "h")
    texts = rows.select(F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.col(lang_col).alias("lang")).join(F.broadcast(chosen), ["h", "lang"], "left_semi").dropDuplicates(["h", "lang"])

    def features(batches):
        for batch in batches:
            made = [counts((t or "").encode()) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([a.astype("<u4").tobytes() for a, _ in made]), pa.array([n.astype("<u4").tobytes() for _, n in made])], ["h", "lang", "at", "n"])

    # the counts stay in the buffers they came in: copies of them would add up in the driver
    got = texts.select("text", "h", "lang").mapInArrow(features, "h long, lang string, at binary, n binary").toArrow()
    order = pc.sort_indices(got.select(["h", "lang"]), sort_keys=[("h", "ascending"), ("lang", "ascending")]).to_pylist()
    index = {x: i for i, x in enumerate(sorted(langs))}
    labels = np.array([index[got["lang"][k].as_py()] for k in order], dtype=np.int64)
    examples = [tuple(np.frombuffer(got[c][k].as_buffer(), "<u4") for c in ("at", "n")) for k in order]
    hold = np.arange(len(labels)) % 5 == 4
    scores, bias = train([e for e, h in zip(examples, hold) if not h], labels[~hold], len(index))
    scores = scores.astype(np.float32)  # as prediction has them
    logits = np.array([(n / n.sum()) @ scores[a] + bias for (a, n), h in zip(examples, hold) if h]).reshape(-1, len(index))
    temperature, least = calibrate(logits, labels[hold], keep)
    return Model(sorted(index), scores, bias, temperature, least)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and accepted (score at least the calibrated bound); columns with these names are replaced.

    Whole texts are read; a text that is null or has no letter is UNKNOWN, with score 0, rejected.
    """
    made = ("lang_pred", "score", "accepted")
    docs = docs.drop(*[c for c in made if c in docs.columns])
    names, at = docs.columns, docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets times languages

    def run(batches):
        own = shared.value
        for batch in batches:
            said = [own.predict(t.as_py()) for t in batch.column(at)]
            columns = [pa.array([x for x, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64()), pa.array([x != UNKNOWN and s >= own.least for x, s in said], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *made])

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema], "lang_pred string", "score double", "accepted boolean"])
    return docs.mapInArrow(run, schema)
