"""Secrets in documents: candidates by pattern, false positives removed by a
random forest, in DataFrame functions only.

A candidate is a run of 16 or more characters of keys and tokens. Its features
are its length and make-up, how likely its character transitions are in the
corpus' words, how much of it dictionary words cover, the path it was found
under, and the words in front of it. The dictionary and the transitions are
counted over the whole corpus.

The forest is trained on labelled findings. Where none are given, the findings
that fixed rules decide beyond doubt (:func:`seed_labels`) are the labelled
ones. Training reads at most ``max_labelled`` findings of each label, the
first in hash order of their value, and runs on the driver; the trained
trees are applied as plain SQL expressions.

Defined results: a null or empty text has no findings, a null path is the
empty path; repeated rows are reported one by one; without labelled findings
of both kinds no finding is removed (probability 1); an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.sanitise import bound, matches_of

CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}+"
#: Characters in front of a candidate that are its neighbourhood.
NEIGHBOURHOOD = 32
# Words that speak for and against a secret.
SECRET_WORDS = "token|secret|passw|pwd|api.?key|access.?key|private|auth|bearer|credential"
HASH_WORDS = "sha|md5|commit|checksum|digest|hash|uuid|revision|etag"
TEST_PATHS = "test|example|sample|mock|fixture|demo|doc"

#: Documents that a word must occur in to be a dictionary word.
DICTIONARY_MIN = 10
#: log2 probability of a transition that no word makes.
UNSEEN = -12.0
FEATURES = ("length", "digit_share", "upper_share", "distinct_share", "switches", "transition", "coverage",
            "is_hex", "assigned", "quoted", "secret_word", "hash_word", "test_path", "path_depth")
MAX_LABELLED = 3000


def dictionary(docs: DataFrame, text_col: str = "text", least: int = DICTIONARY_MIN) -> DataFrame:
    """``word, n``: words of letters that occur in ``least`` documents or more."""
    words = F.regexp_extract_all(F.lower(F.col(text_col).cast("string")), F.lit(r"\p{L}{3,}+"), F.lit(0))
    return (docs.select(F.explode(F.array_distinct(words)).alias("word"))
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least))


def _plain(text: Column) -> Column:
    """Letters a-z as they are, any other character as ``?``."""
    return F.regexp_replace(F.lower(text), "[^a-z]", "?")


def _pairs(text: Column) -> Column:
    """Every two neighbouring characters, from one cut of the text into characters."""
    def neighbours(c: Column) -> Column:
        return F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.concat(a, b))
    characters = bound(F.split(text, "(?!^)(?!$)", -1), neighbours)
    return F.when(F.length(text) > 1, characters).otherwise(F.array().cast("array<string>"))


def transitions(words: DataFrame) -> dict[str, float]:
    """log2 probability of a character after another in the dictionary; 27 x 27 pairs at most."""
    counts = (words.select(F.explode(_pairs(_plain(F.col("word")))).alias("pair"), "n")
              .groupBy("pair").agg(F.sum("n").alias("n")).collect())
    first: dict[str, int] = {}
    for pair, n in counts:
        first[pair[0]] = first.get(pair[0], 0) + n
    return {pair: float(np.log2((n + 1) / (first[pair[0]] + 27))) for pair, n in counts}


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """Every candidate with its place (code points) and the features that need no corpus."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.lower(F.coalesce(F.col(path_col).cast("string"), F.lit(""))) if path_col else F.lit("")
    found = (docs.select(F.col(id_col).alias("id"), text.alias("text"), path.alias("path"))
             .select("id", "path", "text", F.inline(matches_of(F.col("text"), CANDIDATE, F.lit(True)))))
    low = F.greatest(F.lit(0), F.col("start") - NEIGHBOURHOOD)
    found = found.select("id", "start", "end", "value", "path",
                         F.substr("text", low + 1, F.col("start") - low).alias("before"))
    value, size = F.col("value"), F.length("value").cast("double")

    def share(of: str) -> Column:
        return F.length(F.regexp_replace(value, f"[^{of}]", "")) / size

    def says(column: str, words: str) -> Column:
        return F.regexp_like(F.lower(F.col(column)), F.lit(words)).cast("double")

    switches = F.size(F.split(value, "(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])", -1)) - 1
    return found.select(
        "id", "start", "end", "value", size.alias("length"), share("0-9").alias("digit_share"),
        share("A-Z").alias("upper_share"),
        (F.size(F.array_distinct(F.split(value, "(?!^)(?!$)"))) / size).alias("distinct_share"),
        (switches / size).alias("switches"), F.regexp_like(value, F.lit("^[0-9A-Fa-f]+$")).cast("double").alias("is_hex"),
        F.regexp_like("before", F.lit("[=:]\\s*[\"'`]?$")).cast("double").alias("assigned"),
        F.regexp_like("before", F.lit("[\"'`]$")).cast("double").alias("quoted"),
        says("before", SECRET_WORDS).alias("secret_word"), says("before", HASH_WORDS).alias("hash_word"),
        says("path", TEST_PATHS).alias("test_path"),
        (F.size(F.split("path", "/")) - 1).cast("double").alias("path_depth"))


def with_corpus_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``transition`` and ``coverage`` beside the other features."""
    chance = transitions(words)
    pairs = _pairs(_plain(F.col("value")))
    if chance:
        table = F.create_map(*[F.lit(x) for kv in sorted(chance.items()) for x in kv])
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.coalesce(F.element_at(table, p), F.lit(UNSEEN)))
    else:
        total = F.size(pairs) * F.lit(UNSEEN)
    runs = (found.select("value").distinct()
            .select("value", F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{3,}+"), F.lit(0))).alias("word")))
    covered = (runs.join(words.select("word"), "word").groupBy("value").agg(F.sum(F.length("word")).alias("covered")))
    return (found.join(covered, "value", "left")
            .withColumn("coverage", F.coalesce("covered", F.lit(0)) / F.col("length")).drop("covered")
            .withColumn("transition", total / F.greatest(F.lit(1.0), F.col("length") - 1)))


def seed_labels() -> Column:
    """1 for findings that are secrets beyond doubt, 0 for ones that aren't, else null."""
    mixed = F.col("digit_share").between(0.1, 0.9) & (F.col("switches") > 0.1)
    named = (F.col("assigned") == 1) & (F.col("secret_word") == 1)
    return (F.when(named & mixed & (F.col("length") >= 20) & (F.col("test_path") == 0), 1)
            .when((F.col("digit_share") == 0) & (F.col("secret_word") == 0) & (F.col("assigned") == 0), 0)
            .when((F.col("is_hex") == 1) & (F.col("hash_word") == 1) & (F.col("secret_word") == 0), 0)
            .when((F.col("digit_share") == 1) & (F.col("secret_word") == 0), 0))


class RandomForest:
    """Trees as nested tuples ``(feature, cut, left, right)``; a leaf is its share of secrets."""

    def __init__(self, trees: list):
        self.trees = trees

    @classmethod
    def fit(cls, rows: np.ndarray, labels: np.ndarray, trees: int = 25, depth: int = 5, seed: int = 11) -> "RandomForest":
        rng = np.random.default_rng(seed)
        tried = max(1, int(np.ceil(np.sqrt(rows.shape[1]))))

        def grow(x: np.ndarray, y: np.ndarray, level: int):
            if level == depth or len(y) < 4 or y.min() == y.max():
                return float(y.mean())
            best, usable = None, 0
            for f in rng.permutation(rows.shape[1]):
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                n = cut + 1.0
                p, q = ones[cut] / n, (ones[-1] - ones[cut]) / (len(y) - n)
                impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
                i = int(np.argmin(impurity))
                if best is None or impurity[i] < best[0]:
                    best = impurity[i], int(f), float((v[cut[i]] + v[cut[i] + 1]) / 2)
                usable += 1
                if usable == tried:
                    break
            if best is None:
                return float(y.mean())
            _, f, at = best
            left = x[:, f] <= at
            return f, at, grow(x[left], y[left], level + 1), grow(x[~left], y[~left], level + 1)

        grown = []
        for _ in range(trees):
            pick = rng.integers(0, len(labels), len(labels))
            grown.append(grow(rows[pick], labels[pick].astype(float), 0))
        return cls(grown)

    def probability(self, row) -> float:
        total = 0.0
        for node in self.trees:
            while isinstance(node, tuple):
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node
        return total / len(self.trees)

    def expression(self, names: tuple[str, ...]) -> Column:
        """The mean of the trees' answers as a SQL expression over columns."""
        def of(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            return F.when(F.col(names[node[0]]) <= node[1], of(node[2])).otherwise(of(node[3]))
        total = of(self.trees[0])
        for node in self.trees[1:]:
            total = total + of(node)
        return total / float(len(self.trees))


def train(findings: DataFrame, label: Column, max_labelled: int = MAX_LABELLED, trees: int = 25,
          seed: int = 11) -> RandomForest | None:
    """Fit the forest on at most ``max_labelled`` findings of each label, different values only."""
    known = findings.select("value", label.cast("int").alias("label"), *FEATURES).where(F.col("label").isin(0, 1))
    rows = []
    for side in (0, 1):
        rows += (known.where(F.col("label") == side).dropDuplicates(["value"])
                 .orderBy(F.xxhash64("value"), "value").limit(max_labelled).collect())
    labels = np.array([r["label"] for r in rows], int)
    if not len(rows) or labels.min() == labels.max():
        return None
    return RandomForest.fit(np.array([[r[f] for f in FEATURES] for r in rows], float), labels, trees, seed=seed)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None,
         label: Column | None = None, least: float = 0.5, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """``id_col, start_at, end_at, n_chars, value_sha256, probability`` of every
    finding that the forest takes for a secret. ``label``: an expression over
    the findings' columns that is 1, 0 or null; default :func:`seed_labels`."""
    words = dictionary(docs, text_col).checkpoint()
    found = with_corpus_features(candidates(docs, id_col, text_col, path_col), words).checkpoint()
    forest = train(found, seed_labels() if label is None else label, max_labelled)
    chance = forest.expression(FEATURES) if forest else F.lit(1.0)
    scored = found.select(F.col("id").alias(id_col), F.col("start").cast("long").alias("start_at"),
                          F.col("end").cast("long").alias("end_at"), F.col("length").cast("long").alias("n_chars"),
                          F.sha2("value", 256).alias("value_sha256"), chance.alias("probability"))
    return scored.where(F.col("probability") >= least)
