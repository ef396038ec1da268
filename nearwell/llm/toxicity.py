"""Toxicity by compression distance.

One zstandard dictionary is trained, on windows of ordinary texts. The other holds the same and a list
of single words that a frequency ratio picks from toxic texts, so a window only compresses better where
it resembles the toxic material. Every two-word window of a text is compressed with both. How far the
lengths differ, and in how many windows by more than a calibrated threshold, goes through a logistic
calibration to a score.

Windows are followed by a filler that both dictionaries hold, since zstandard stores very short
inputs uncompressed.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound on the labelled rows of each class that the dictionaries and the calibration are fitted on.
TRAIN_PER_CLASS = 2000
WINDOW_WORDS = 2
LEVEL = 4
BASE_BYTES = 6000
TOXIC_BYTES = 6000
FILLER = b"=0123456789abcdefghijklmnopqrstuvwxyz="
TRIM = string.punctuation


def windows(text: str, size: int = WINDOW_WORDS) -> list[bytes]:
    """Lower-case, trimmed words in consecutive groups, as bytes."""
    words = [w.strip(TRIM) for w in text.lower().split()]
    return [f" {' '.join(words[i:i + size])} ".encode() + FILLER for i in range(0, len(words), size)]


@dataclass
class Model:
    """What scoring needs: dictionary contents, threshold, logistic weights; under 20 KB."""

    base: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]
    prior: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        out = []
        for content in (self.base, self.base + self.toxic):
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(LEVEL)
            out.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False,
                write_checksum=False))
        return out[0], out[1]


def gains(text: str, ordinary, toxic) -> np.ndarray:
    """Per window, the bytes that the toxic dictionary saves against the ordinary one."""
    seen = windows(text)
    one, two = ordinary.compress, toxic.compress
    return np.fromiter((len(one(w)) - len(two(w)) for w in seen), np.int64, len(seen))


def features(gain: np.ndarray, threshold: int) -> list[float]:
    if not len(gain):
        return [0.0, 0.0, 0.0, 0.0]
    top = np.sort(gain)[::-1][:2]
    over = int((gain >= threshold).sum())
    return [float(top[0]), float(top[-1]), float(np.log1p(over)), over / len(gain)]


def _distinct(texts: list[str]) -> list[str]:
    """The texts without those that mostly repeat five-word runs of earlier ones."""
    seen: set[int] = set()
    out = []
    for text in texts:
        words = text.split()
        runs = [hash(tuple(words[i:i + 5])) for i in range(len(words) - 4)]
        if sum(r in seen for r in runs) <= 0.2 * len(runs):
            out.append(text)
        seen.update(runs)
    return out


def _word_counts(texts: list[str]) -> Counter:
    counts: Counter = Counter()
    for text in texts:
        counts.update({w.strip(TRIM) for w in text.lower().split()})
    return counts


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content part of a trained dictionary, or the samples where there are too few to train."""
    try:
        return zstandard.train_dictionary(size + 2000, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def fit(toxic: list[str], ordinary: list[str], share: float) -> Model | None:
    """A model of sample texts; ``share`` is how much of all labelled rows is toxic.

    None if a class has no texts.
    """
    toxic, ordinary = _distinct(sorted(toxic)), _distinct(sorted(ordinary))
    if not toxic or not ordinary:
        return None
    bad, good = _word_counts(toxic), _word_counts(ordinary)
    likely = {w for w, n in bad.items() if w and n >= max(3, 0.01 * len(toxic))
              and n / len(toxic) >= 10 * (good[w] + 0.5) / len(ordinary)}
    # words of passages that texts copy from each other always have the same neighbours
    around: dict[str, list] = {w: [] for w in likely}
    for text in toxic:
        words = ["", *(w.strip(TRIM) for w in text.lower().split()), ""]
        for i, w in enumerate(words):
            if w in likely:
                around[w].append((words[i - 1], words[i + 1]))
    marks = sorted(w for w, near in around.items() if len(set(near)) >= 0.7 * len(near))
    rows = np.random.default_rng(0)
    cut = -len(FILLER)
    plain = [w[:cut] for t in ordinary for w in windows(t, 4)]
    plain = [plain[i] for i in rows.permutation(len(plain))[:60_000]]
    marked = set(marks)
    # passages around the telling words, cut down to those words
    telling = [b" " + w.encode() + b" " for t in toxic for w in
               (x.strip(TRIM) for x in t.lower().split()) if w in marked]
    base = _dictionary(plain, BASE_BYTES) + FILLER
    common = Counter(telling).most_common()
    content = b"".join(w for w, _ in reversed(common))[-TOXIC_BYTES:]
    model = Model(base, content, 1, (), share)
    pair = model.compressors()
    all_gains = [gains(t, *pair) for t in toxic + ordinary]
    label = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    top = np.array([g.max(initial=0) for g in all_gains])
    cuts = range(1, 12)
    model.threshold = max(cuts, key=lambda c: ((top >= c) == (label > 0)).mean())
    x = np.column_stack(([1.0] * len(label), [features(g, model.threshold) for g in all_gains]))
    x = x.reshape(len(label), -1)
    weights = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a lightly penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        weights += np.linalg.solve(hess, x.T @ (label - p) - 0.1 * weights)
    # the sample's share of toxic rows is not the labels'
    sampled = label.mean()
    weights[0] += np.log(share / (1 - share)) - np.log(sampled / (1 - sampled)) if 0 < share < 1 else 0
    model.weights = tuple(float(w) for w in weights)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> Model | None:
    """Fit on at most ``per_class`` labelled rows of each class that are not held out.

    The rows are those of the smallest hashed ids. Null labels and ids, and blank texts, are left
    out. Only this sample comes to the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(
        ~held_out(F.col("doc_id"))).select("doc_id", "toxic").distinct()
    share = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    texts = []
    for value in (1, 0):
        ids = known.where(F.col("toxic") == value).select("doc_id").orderBy(
            F.xxhash64("doc_id"), "doc_id").limit(per_class)
        rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(
            F.col("text").isNotNull()).select("text").limit(2 * per_class).toArrow()
        texts.append([t for t in rows["text"].to_pylist() if t.strip()])
    return fit(texts[0], texts[1], share)


def _scores(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors() if model else None
        for batch in batches:
            if model:
                x = np.array([features(gains(t or "", *pair), model.threshold)
                              for t in batch.column("text").to_pylist()]).reshape(-1, 4)
                z = model.weights[0] + x @ np.array(model.weights[1:])
                score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                score = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)],
                                             ["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score (0 to 1) of every whole text.

    Null and empty texts have no windows and get the score of a text that resembles nothing toxic;
    without a model (a class had no labelled rows) all scores are 0. Repeated rows are scored each;
    columns besides doc_id and text are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _scores(model), "doc_id long, score double")
