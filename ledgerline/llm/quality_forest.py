"""Quality rules with an isolation forest over the rules' statistics.

Every whole text gets the statistics of the usual quality rules (symbols,
repeated lines and phrases, capitals ...). Two hard rules reject a text
outright. The rest is judged by an isolation forest: trees of random splits
over labelled documents, in which an unusual document is alone after few
splits. What the trees split on is how far each statistic lies outside the
range that labelled good documents span, so that the many ordinary documents
fall together and only deviations shorten a path. The mean path length gives
the anomaly score ``2^(-path / c(sample))``; the score from which a document
is rejected is the one that best separates the labelled good from the
labelled bad rows.

Fitting reads a bounded number of labelled rows (``max_labelled``, taken in
hash order of the id); the statistics and the verdicts cover every row.

Defined results: a null or empty text has no words and so fails the hard
rules; repeated rows get the same verdict; without labelled rows of both
kinds there is no threshold and only the hard rules decide; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import slices_of, texts_as_bytes

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\r\x0b\x0c"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"

#: The exact counts of a text, in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The statistics that the forest splits on.
FEATURES = ("mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "capital_share", "digit_share",
            "top_word_share")
#: Percentiles of a statistic between which a labelled good document is ordinary.
ORDINARY = (0.5, 99.5)
#: How far the ordinary range goes on beyond these, in units of its width.
MARGIN = 0.5


def text_statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The counts and the forest's statistics of one text (UTF-8)."""
    words = text.split()
    n = len(words)
    word_chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [line for line in text.split(b"\n") if line.strip()]
    dup_lines = len(lines) - len(set(lines))
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeats = repeated_words(ids, len(number))
    per_word = 1.0 / n if n else 0.0
    per_char = 1.0 / word_chars if word_chars else 0.0
    top = int(np.bincount(ids).max()) if n else 0
    return (
        [n, word_chars, symbols, dup_lines, repeats],
        [word_chars * per_word, symbols * per_word, dup_lines / len(lines) if lines else 0.0, repeats * per_word,
         (len(text) - len(text.translate(None, CAPITALS))) * per_char,
         (len(text) - len(text.translate(None, DIGITS))) * per_char, top * per_word])


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside 3-word windows that occur twice or more; ``ids`` numbers the words from 0."""
    n = len(ids)
    if n < 4:
        return 0
    # two words make a pair id, which is numbered anew so that no product overflows
    pair = ids[:-1] * n_distinct + ids[1:]
    pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * np.int64(n_distinct) + ids[2:]
    _, inverse, times = np.unique(window, return_inverse=True, return_counts=True)
    twice = times[inverse] > 1
    if not twice.any():
        return 0
    inside = np.zeros(n, bool)
    inside[:-2] |= twice
    inside[1:-1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree of ``n`` rows."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


@dataclass
class IsolationForest:
    """Trees as flat arrays: node i of a tree splits on ``feature[i]`` at
    ``value[i]`` into nodes 2i+1 and 2i+2; a leaf has feature -1 and holds its
    path length in ``value``."""

    feature: np.ndarray  # trees x nodes
    value: np.ndarray
    sample: int

    @classmethod
    def fit(cls, rows: np.ndarray, trees: int = 200, sample: int = 256, seed: int = 7) -> "IsolationForest":
        rng = np.random.default_rng(seed)
        sample = min(sample, len(rows))
        depth = max(1, int(np.ceil(np.log2(max(2, sample)))))
        feature = np.full((trees, 2 ** (depth + 1) - 1), -1, np.int16)
        value = np.zeros(feature.shape)
        for t in range(trees):
            todo = [(0, 0, rows[rng.choice(len(rows), sample, replace=False)])]
            while todo:
                node, level, part = todo.pop()
                low, high = part.min(0), part.max(0)
                usable = np.flatnonzero(high > low)
                if level == depth or len(part) < 2 or not len(usable):
                    value[t, node] = level + average_path(len(part))
                    continue
                f = int(rng.choice(usable))
                cut = max(rng.uniform(low[f], high[f]), np.nextafter(low[f], high[f]))  # neither side is empty
                feature[t, node], value[t, node] = f, cut
                left = part[:, f] < cut
                todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]
        return cls(feature, value, sample)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score per row, towards 1 for rows that few splits isolate."""
        paths = np.zeros(len(rows))
        at = np.arange(len(rows))
        for feature, value in zip(self.feature, self.value):
            node = np.zeros(len(rows), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = rows[at, np.maximum(f, 0)] >= value[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            paths += value[node]
        return 2.0 ** (-(paths / max(1, len(self.feature))) / max(float(average_path(self.sample)), 1e-9))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the counts of ``COUNTS`` and ``features array<double>`` of every whole text; no shuffle."""
    schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("features", pa.list_(pa.float64()))])

    def run(batches):
        for batch in batches:
            for part in slices_of(batch, "text", 4 << 20):
                found = [text_statistics(t) for t in texts_as_bytes(part.column("text"))]
                counts = np.array([c for c, _ in found], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), *(pa.array(counts[:, i]) for i in range(len(COUNTS))),
                     pa.array([f for _, f in found], schema.field("features").type)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return (rows.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>")
            .withColumnRenamed("id", id_col))


def hard_rules():
    """True where a text is rejected outright: too short, or half of it repeated phrases."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass
class QualityModel:
    """``low`` and ``high`` bound the ordinary range of every statistic."""

    low: np.ndarray
    high: np.ndarray
    forest: IsolationForest | None = None
    threshold: float = 1.0

    def deviation(self, rows: np.ndarray) -> np.ndarray:
        """How far outside the ordinary range, in units of its width; 0 inside."""
        width = np.maximum(self.high - self.low, 0.01)
        return np.maximum(np.maximum(rows - self.high, self.low - rows), 0) / width

    def anomalous(self, rows: np.ndarray) -> np.ndarray:
        if self.forest is None or not len(rows):
            return np.zeros(len(rows), bool)
        return self.forest.score(self.deviation(rows)) > self.threshold


def ordinary_range(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of every statistic in which a document like these rows is ordinary."""
    low, high = np.percentile(rows, ORDINARY, axis=0)
    return low - MARGIN * (high - low), high + MARGIN * (high - low)


def best_threshold(good: np.ndarray, bad: np.ndarray) -> float:
    """The score above which rejecting makes the smallest summed error rate of
    both classes; between two neighbouring scores, their middle."""
    scores = np.concatenate([good, bad])
    order = np.argsort(scores, kind="stable")
    scores, is_bad = scores[order], np.concatenate([np.zeros(len(good)), np.ones(len(bad))])[order]
    # error when everything after position i is rejected
    wrong = np.cumsum(is_bad) / len(bad) + 1 - np.cumsum(1 - is_bad) / len(good)
    wrong[:-1][scores[1:] == scores[:-1]] = np.inf  # ties stay on one side
    i = int(np.argmin(wrong))
    return float((scores[i] + scores[min(i + 1, len(scores) - 1)]) / 2)


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "quality", max_labelled: int = 8000, trees: int = 200, sample: int = 128,
              seed: int = 7) -> QualityModel:
    """Fit the forest on one half of the labelled rows that pass the hard
    rules and calibrate its threshold on the other half (on all of them if
    either class is missing from a half); at most ``max_labelled`` labelled
    rows, the first in hash order of their id. A row counts as labelled if its
    label is 0 or 1; of repeated ids the smallest label counts."""
    chosen = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
              .groupBy("id").agg(F.min("label").alias("label"))
              .orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # at most max_labelled (id, label) rows: a proven bound for the broadcast
    labelled = texts.join(F.broadcast(chosen), "id")
    rows = (statistics(labelled, "id", "text").where(~hard_rules())
            .join(F.broadcast(chosen), "id").orderBy("id").limit(max_labelled).select("label", "features").collect())
    label = np.array([r[0] for r in rows], int)
    found = np.array([r[1] for r in rows], float).reshape(len(rows), len(FEATURES))
    good, bad = label == 1, label == 0
    if not good.any() or not bad.any():
        return QualityModel(np.zeros(len(FEATURES)), np.zeros(len(FEATURES)))
    half = np.zeros(len(label), bool)
    shuffled = np.random.default_rng(seed).permutation(len(label))
    for kind in (good, bad):
        half[shuffled[kind[shuffled]][::2]] = True
    held = ~half if (good & ~half).any() and (bad & ~half).any() else np.ones(len(label), bool)
    model = QualityModel(*ordinary_range(found[good & half]))
    model.forest = IsolationForest.fit(model.deviation(found[half]), trees, sample, seed)
    score = model.forest.score(model.deviation(found))
    model.threshold = best_threshold(score[good & held], score[bad & held])
    return model


def judge(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """``base_failed`` and ``kept`` beside the statistics of :func:`statistics`."""
    schema = pa.schema([("id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()),
                        ("kept", pa.bool_())])

    def run(batches):
        for batch in batches:
            values = batch.column("features").flatten().to_numpy(zero_copy_only=False)
            failed = batch.column("base_failed").to_numpy(zero_copy_only=False).astype(bool)
            odd = model.anomalous(values.reshape(batch.num_rows, len(FEATURES)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in ("id", *COUNTS)), pa.array(failed), pa.array(~failed & ~odd)], schema=schema)

    rows = (stats.withColumnRenamed(id_col, "id")
            .select("id", *COUNTS, hard_rules().alias("base_failed"), "features"))
    return (rows.mapInArrow(run, "id long, " + ", ".join(f"{c} long" for c in COUNTS)
                            + ", base_failed boolean, kept boolean").withColumnRenamed("id", id_col))


def filter_documents(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules and the forest keep, all columns as they were; no shuffle."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            named = pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], names=["text"])
            start = 0
            for part in slices_of(named, "text", 4 << 20):
                found = [text_statistics(t) for t in texts_as_bytes(part.column(0))]
                counts = np.array([c for c, _ in found], np.int64)
                words, repeats = counts[:, 0], counts[:, 4]
                kept = ~((words < 50) | (100 * repeats > 50 * words))
                kept &= ~model.anomalous(np.array([f for _, f in found], float))
                yield batch.slice(start, part.num_rows).filter(pa.array(kept))
                start += part.num_rows

    return docs.mapInArrow(run, docs.schema)
