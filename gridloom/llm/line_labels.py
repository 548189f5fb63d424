"""Quality rules by line labelling: a linear-chain conditional random field marks each line content or boilerplate.

The field has a weight for each line feature and label and one for each pair of neighbouring labels. It is fitted
on a sample of at most ``per_class`` documents of each quality label (by hash of id and text). Only documents are labelled, so the
labels of lines are latent: fitting starts from lines that take their document's label, then alternates between labelling
the lines by their posterior, under the constraint that lines with at least half of a document's words have its label, and gradient
ascent on the likelihood of these line labels. A good line in a bad document can thus be content, and the reverse. Viterbi decoding then labels the lines of every whole text, and a
document is kept when at least ``min_share`` of its words are in content lines.

Documents fail the base rules with fewer than ``min_words`` words, or when over ``max_repeat`` % of the words are in
three-word windows that occur twice or more. Null and empty texts have no words and fail. Without labelled documents every
line is content. Repeated rows give equal rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import bounded_sample, chunks, map_exact

# Byte classes: letters (bytes past ASCII count as such), capitals, digits, marks of markup, other punctuation.
CLASSES = np.zeros((5, 256), dtype=np.int64)
CLASSES[0, [*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
CLASSES[1, 65:91] = 1
CLASSES[2, 48:58] = 1
CLASSES[3, list(b"#*$%&|<>")] = 1
CLASSES[4, list(b"!?=_~^@+/\\{}[]\"")] = 1
# Code points are bytes that don't continue one.
HEADS = np.ones(256, dtype=bool)
HEADS[128:192] = False
FEATURES = 12


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(features, words) of each line of a text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    sums = [np.concatenate(([0], np.cumsum(c[data]))) for c in CLASSES]
    letters, capitals, digits, marks, others = (s[ends] - s[starts] for s in sums)
    gap = hashing.SPACE[data]
    begins = np.concatenate(([0], np.cumsum(~gap & np.concatenate(([True], gap[:-1])))))
    words = begins[ends] - begins[starts]
    solid = np.concatenate(([0], np.cumsum(~gap)))
    size = np.maximum(1, solid[ends] - solid[starts])
    last = data[np.maximum(ends - 1, 0)]
    lines = text.split("\n")
    seen: set[str] = set()
    again = np.zeros(len(lines))
    for i, line in enumerate(lines):
        if line in seen:
            again[i] = 1
        seen.add(line)
    x = np.zeros((len(lines), FEATURES))
    x[:, 0] = 1
    x[:, 1] = np.log1p(words)
    x[:, 2] = letters / size
    x[:, 3] = capitals / np.maximum(1, letters)
    x[:, 4] = digits / size
    x[:, 5] = marks / size
    x[:, 6] = np.minimum(1, 5 * marks / np.maximum(1, words))
    x[:, 7] = np.minimum(1, 5 * others / np.maximum(1, words))
    x[:, 8] = np.isin(last, list(b".?!"))
    x[:, 9] = np.minimum(2, size / np.maximum(1, words) / 8)
    x[:, 10] = again
    x[:, 11] = words == 0
    return x, words


def viterbi(score: np.ndarray, step: np.ndarray) -> np.ndarray:
    """The best labels (0 content, 1 boilerplate) for line scores [n, 2] and neighbour weights [2, 2]; ties go to content."""
    back = []
    a, b = float(score[0, 0]), float(score[0, 1])
    (s00, s01), (s10, s11) = step.tolist()
    for e0, e1 in score[1:].tolist():
        from0, from1 = b + s10 > a + s00, b + s11 > a + s01
        back.append((from0, from1))
        a, b = (b + s10 if from0 else a + s00) + e0, (b + s11 if from1 else a + s01) + e1
    state = int(b > a)
    out = [state]
    for choice in reversed(back):
        state = int(choice[state])
        out.append(state)
    return np.array(out[::-1])


def posteriors(score: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each line's label [n, 2] and expected counts of neighbouring labels [2, 2], by forward and backward sums."""
    n = len(score)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = score[0]
    for t in range(1, n):
        forward[t] = np.logaddexp.reduce(forward[t - 1][:, None] + step, axis=0) + score[t]
    for t in range(n - 2, -1, -1):
        backward[t] = np.logaddexp.reduce(step + score[t + 1] + backward[t + 1], axis=1)
    total = np.logaddexp.reduce(forward[-1])
    pairs = np.exp(forward[:-1, :, None] + step + (score[1:] + backward[1:])[:, None, :] - total).sum(axis=0) if n > 1 else np.zeros((2, 2))
    return np.exp(forward + backward - total), pairs


def likelihood_gradient(x: np.ndarray, labels: np.ndarray, weights: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of the log likelihood of a document's line labels."""
    p, pairs = posteriors(x @ weights.T, step)
    target = np.zeros((len(x), 2))
    target[np.arange(len(x)), labels] = 1
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1], labels[1:]), 1)
    return (target - p).T @ x, seen - pairs


def latent_labels(boilerplate: np.ndarray, words: np.ndarray, label: int) -> np.ndarray:
    """Line labels by posterior; the surest lines of the document's own label are taken until they hold half of its words."""
    own = boilerplate if label else 1 - boilerplate
    order = np.argsort(-own, kind="stable")
    before = np.cumsum(words[order]) - words[order]
    mine = own >= 0.5
    mine[order[2 * before < words.sum()]] = True
    return np.where(mine, label, 1 - label)


def _sample(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for quality, text in zip(frame["quality"], frame["text"], strict=True):
            x, words = line_features(text)
            rows.append((quality, x.astype(np.float32).tobytes(), words.astype(np.int64).tobytes()))
        yield pd.DataFrame(rows, columns=["quality", "x", "words"])


def climb(train: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, step: np.ndarray, rounds: int, linked: bool) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive gradient ascent on (features, line labels); both labels weigh the same. Without ``linked`` neighbours don't count."""
    share = np.maximum(1, sum(np.bincount(y, minlength=2) for _, y in train))
    gw, gs = np.full_like(weights, 1e-6), np.full_like(step, 1e-6)
    for _ in range(rounds):
        dw, ds = -0.02 * weights, -0.02 * step
        for x, y in train:
            by = 1 / share[y]
            a, b = likelihood_gradient(x, y, weights, step)
            dw, ds = dw + a * by.mean(), ds + b * by.mean()
        gw, gs = gw + dw * dw, gs + ds * ds
        weights = weights + 0.5 * dw / np.sqrt(gw)
        step = step + 0.5 * ds / np.sqrt(gs) if linked else step
    return weights, step


def fit(docs: DataFrame, per_class: int = 150, rounds: int = 12, turns: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights [2, FEATURES] and neighbour weights [2, 2], from (id, text, quality) rows with quality 1 (content) or 0."""
    docs = docs.filter("text is not null and text <> '' and quality in (0, 1)")
    rows = bounded_sample(docs, "quality", per_class, "id", "text").mapInPandas(_sample, "quality int, x binary, words binary").collect()
    rows = sorted((r["quality"], bytes(r["x"]), bytes(r["words"])) for r in rows)
    weights, step = np.zeros((2, FEATURES)), np.zeros((2, 2))
    if len({r[0] for r in rows}) < 2:
        weights[0, 0] = 1.0
        return weights, step
    sample = [(1 - q, np.frombuffer(x, dtype=np.float32).reshape(-1, FEATURES).astype(float), np.frombuffer(w, dtype=np.int64)) for q, x, w in rows]
    lines = [np.full(len(x), label) for label, x, _ in sample]
    # lines by themselves first: with their document's label, no neighbour ever differs
    weights, step = climb([(x, y) for (_, x, _), y in zip(sample, lines, strict=True)], weights, step, 2 * rounds, False)
    for _ in range(turns):
        lines = [latent_labels(posteriors(x @ weights.T, step)[0][:, 1], words, label) for label, x, words in sample]
        weights, step = climb([(x, y) for (_, x, _), y in zip(sample, lines, strict=True)], weights, step, rounds, True)
    return weights, step


def repeated_words(words: np.ndarray, width: int = 3) -> int:
    """Words in windows of ``width`` words that occur twice or more."""
    if len(words) <= width:
        return 0
    h = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        h = h * np.uint64(hashing.BASE) + words[i : i + len(h)]
    order = np.argsort(h, kind="stable")
    same = np.concatenate(([False], h[order][1:] == h[order][:-1], [False]))
    again = order[same[1:] | same[:-1]]
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + width, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, labels array<byte>"


def _judge(model, min_words: int, max_repeat: int, min_share: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, step = model.value
        for frame in frames:
            for part in chunks(frame, "text"):
                texts = part["text"].tolist()
                hashes, bounds = hashing.word_hashes(texts, lower=False)
                rows = []
                for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
                    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
                    n = int(b - a)
                    chars = int((HEADS[data] & ~hashing.SPACE[data]).sum())
                    symbols = int(CLASSES[3][data].sum())
                    repeat = repeated_words(hashes[a:b])
                    failed = n < min_words or 100 * repeat > max_repeat * n
                    if text is None or n == 0:
                        rows.append((n, chars, symbols, 0, repeat, failed, False, 0.0, None if text is None else np.zeros(text.count("\n") + 1, dtype=np.int8)))
                        continue
                    x, words = line_features(text)
                    again = int((x[:, 10].astype(bool) & (words > 0)).sum())
                    labels = viterbi(x @ weights.T, step)
                    share = float(words[labels == 0].sum() / n)
                    rows.append((n, chars, symbols, again, repeat, failed, not failed and share >= min_share, share, labels.astype(np.int8)))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
                out.insert(0, "id", part["id"].to_numpy())
                yield out

    return run


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", per_class: int = 150, min_words: int = 50, max_repeat: int = 50, min_share: float = 0.5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share, labels) of each row."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(quality_col).cast("int").alias("quality")).filter("id is not null").dropDuplicates(["id"])
    # labelled texts: the small table of labels decides by id; only a bounded number of texts comes back
    model = spark.sparkContext.broadcast(fit(texts.join(known, "id"), per_class))
    return map_exact(texts, ["id"], _judge(model, min_words, max_repeat, min_share), RESULT).withColumnRenamed("id", id_col)
