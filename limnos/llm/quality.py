"""Quality rules with an isolation forest on the rules' statistics.

Every text is measured in one pass.  An isolation forest is grown on a bounded
sample of the statistics (``fit_rows`` rows of least hash): short paths over
random splits mark documents that are easily set apart.  The threshold is set on
all labelled rows: the anomaly score that at most ``spare`` of the good ones
exceed.  The base rules reject on their own.

Defined results: a NULL text has no words and fails the base rules; without good
labelled rows only the base rules decide; repeated rows and labels count as often
as they occur (a document labelled both ways counts as good); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import WordHashes, hash_sample, ship_with_tasks, stored

ship_with_tasks(__name__)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
FEATURES = 8
FIT_ROWS = 8192
TREES = 100
TREE_ROWS = 256
SPARE = 0.001

# Fixed value: the symbols that the symbol rule counts.
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_BLANKS = np.frombuffer(b" \t\n\r\x0b\f", np.uint8)


def measure(text: str | None, memo: WordHashes) -> tuple[int, ...]:
    """The ``COUNTS`` of one text."""
    raw = (text or "").encode()
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    chars = int(bytes_.sum() - bytes_[0x80:0xC0].sum() - bytes_[_BLANKS].sum())
    lines = raw.split(b"\n") if raw else []
    with_word = [x for x in lines if x.strip()]
    repeated = 0
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, n)
    if n >= 4:
        w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[:-2] >> np.uint64(31))
        w = (w + h[1:-1]) * np.uint64(0xBF58476D1CE4E5B9)
        w = ((w ^ (w >> np.uint64(29))) + h[2:]) * np.uint64(0x94D049BB133111EB)
        ordered = np.sort(w)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(again):
            found = np.nonzero(np.isin(w, again))[0]
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[found + k] = True
            repeated = int(covered.sum())
    letters = int(bytes_[65:91].sum() + bytes_[97:123].sum() + bytes_[0xC0:].sum())
    digits = int(bytes_[48:58].sum())
    return (n, chars, int(bytes_[_SYMBOLS].sum()), len(with_word) - len(set(with_word)), repeated, len(lines),
            int(bytes_[65:91].sum()), digits, chars - letters - digits, len(np.unique(h)))


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        rows = [measure(t.as_py(), memo) for t in batch.column(0)]
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], *COUNTS])


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, order_key and the ``COUNTS`` per row."""
    src = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("order_key"))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_measure_batches, f"doc_id {kind}, order_key long, " + ", ".join(f"{c} long" for c in COUNTS))


def features(counts: np.ndarray) -> np.ndarray:
    """Rule statistics (rows x FEATURES) of rows of ``COUNTS``; digits are left to the search for personal data."""
    n, chars, symbols, dup, repeat, lines, upper, digits, marks, distinct = counts.T.astype(float)
    n1, c1 = np.maximum(n, 1), np.maximum(chars, 1)
    expected = n1 ** 0.8  # distinct words grow about so with the length of a text
    return np.stack([chars / n1, symbols / n1, dup / np.maximum(lines, 1), repeat / n1, upper / c1, marks / c1,
                     np.minimum(distinct / expected, 3.0), np.minimum(n1 / np.maximum(lines, 1), 200.0)], axis=1)


class IsolationForest:
    """Random split trees as flat arrays: feature (-1 at a leaf), split, left child, path length."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = min(rows, len(sample))
        self.depth = max(1, math.ceil(math.log2(max(self.size, 2))))
        self.trees = [self._grow(sample[rng.choice(len(sample), self.size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _mean_path(n: int) -> float:
        """Mean path of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 1.0 if n == 2 else 2.0 * (math.log(n - 1) + 0.5772156649) - 2.0 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def add(x: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, depth + self._mean_path(len(x))])
            lo, hi = x.min(axis=0), x.max(axis=0)
            usable = np.nonzero(hi > lo)[0]
            if depth < self.depth and len(x) > 1 and len(usable):
                f = int(rng.choice(usable))
                split = rng.uniform(lo[f], hi[f])
                below = x[:, f] < split
                if below.any() and not below.all():
                    nodes[at][0], nodes[at][1] = f, split
                    add(x[below], depth + 1)  # the left child stands right behind its parent
                    nodes[at][2] = add(x[~below], depth + 1)
            return at

        add(rows, 0)
        f, s, r, p = zip(*nodes, strict=True)
        return np.array(f, np.int64), np.array(s), np.array(r, np.int64), np.array(p)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1); higher is easier to isolate."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for f, split, right, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = f[at] >= 0
                go_left = x[every, f[at]] < split[at]
                at = np.where(inner, np.where(go_left, at + 1, right[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self._mean_path(self.size), 1e-9))


def _forest_batches(forest: IsolationForest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1)
            score = forest.score(features(counts)) if len(counts) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, "score"])
    return run


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          fit_rows: int = FIT_ROWS, spare: float = SPARE) -> DataFrame:
    """Per row: doc_id, COUNTS, score, threshold, base_failed, kept."""
    counts = stored(rule_counts(docs, id_col, text_col), "quality-counts")
    sample = sorted(hash_sample(counts.where("n_words > 0"), fit_rows, "order_key").select(*COUNTS).collect())
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in counts.schema)
    if sample:
        forest = IsolationForest(features(np.array([tuple(r) for r in sample], dtype=np.int64)))
        scored = stored(counts.mapInArrow(_forest_batches(forest), kinds + ", score double"), "quality-scores")
    else:
        scored = counts.withColumn("score", F.lit(0.5))
    base = (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))
    good = labels.where("quality = 1").select(F.col("doc_id").alias("good_id")).distinct()
    passing = scored.where(~base).join(good, F.col("doc_id") == F.col("good_id"))
    limit = passing.agg(F.percentile_approx("score", F.lit(1.0 - spare), F.lit(100_000)).alias("t")).first()["t"]
    threshold = F.lit(limit).cast("double")
    return scored.drop("order_key").select("*", threshold.alias("threshold"), base.alias("base_failed"),
                                           (~base & F.coalesce(F.col("score") <= threshold, F.lit(True))).alias("kept"))
