"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last two lines decides after which lines a
text is cut, so equal passages are cut alike wherever they stand and whatever
was put in before them.  Several independent cuts (seeds) are made, since one
cut may join a passage's edge to foreign lines.  These chunks have two or more
lines; besides, every least run of over 50 words is a chunk, of one line too.
Least runs lie wholly inside any passage of over 50 words and cover it, so such
a passage is found to its edges whatever stands around it.  A chunk that occurs
more than once in the whole corpus is removed everywhere but at its first place
(least document, then line), after its bytes were compared with that place's
bytes.

Only chunk hashes are shuffled for the count; the bytes of repeated chunks alone
are fetched for the comparison.

Defined results: a NULL text has no lines; chunks of blank lines are not removed;
a passage begins and ends with a line that has words; repeated rows repeat each other's chunks, a NULL id stands first; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import ROW_KEY, keyed_join, row_key, ship_with_tasks, stored

ship_with_tasks(__name__)

SEEDS = 3
#: A cut after about one line in so many.
DIVISOR = 2
LEAST_LINES = 2
#: A passage of so many words is found whole, whatever its number of lines.
LEAST_WORDS = 51

_ODD = np.random.default_rng(7).integers(1 << 20, 1 << 62, (SEEDS, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_runs(lines: list[bytes]) -> list[tuple[int, int]]:
    """(start, n) of the runs of at least LEAST_WORDS words that no line can be taken from at the far end.

    From every line with words the shortest run onwards and the shortest run backwards; and two lines
    with only blank ones between, as no shortest run holds the blank ones if either is long enough alone.
    Any longer run is the union of those inside it: a line of it begins or ends a shortest run in it, or
    too few words stand on both its sides, and then the shortest run from the first line goes past it.
    """
    sizes = [len(x.split()) for x in lines]
    at = [i for i, v in enumerate(sizes) if v]
    sums = [0]
    for i in at:
        sums.append(sums[-1] + sizes[i])
    m, runs, end = len(at), [], 0
    for k in range(m):
        while end < m and sums[end] - sums[k] < LEAST_WORDS:
            end += 1
        if sums[end] - sums[k] < LEAST_WORDS:
            break
        runs.append((k, end))
    start = 0
    for end in range(1, m + 1):
        while sums[end] - sums[start + 1] >= LEAST_WORDS:
            start += 1
        if sums[end] - sums[start] >= LEAST_WORDS:
            runs.append((start, end))
    runs += [(k, k + 2) for k in range(m - 1) if at[k + 1] > at[k] + 1 and sums[k + 2] - sums[k] >= LEAST_WORDS]
    return [(at[a], at[b - 1] + 1 - at[a]) for a, b in runs]


def cut_lines(lines: list[bytes], hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, n, hash) of the chunks of two or more lines, over all seeds, and of the least runs, each once."""
    n = len(lines)
    if n == 0:
        return []
    found = dict.fromkeys(least_runs(lines), 0)
    blank = np.fromiter((not x.strip() for x in lines), bool, n)
    words = np.concatenate([[0], np.cumsum(~blank)])
    for a, b in _ODD:
        rolled = hashes * a
        rolled[1:] ^= hashes[:-1] * b
        rolled ^= rolled >> np.uint64(33)
        rolled *= np.uint64(0xFF51AFD7ED558CCD)
        ends = np.nonzero((rolled >> np.uint64(40)) % np.uint64(DIVISOR) == 0)[0] + 1
        edges = np.unique(np.concatenate([[0], ends, [n]]))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if hi - lo >= LEAST_LINES and words[hi] > words[lo]:
                found[lo, hi - lo] = 0
    made = []
    for lo, size in found:
        h = 0x51ED270B
        for v in hashes[lo:lo + size].tolist():
            h = (h * 0x9E3779B97F4A7C15 + v) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        made.append((lo, size, h - (1 << 64) if h >> 63 else h))
    return made


#: Chunks in one batch, and bytes of chunks in one: a text has several chunks for each of its
#: lines, and overlapping ones may be many times the text, so neither is held for a whole batch of texts.
BATCH_CHUNKS, BATCH_BYTES = 1 << 15, 8 << 20


def _split(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode().split(b"\n")


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> a row with its n_lines and a row for each chunk, in batches of about ``BATCH_CHUNKS``."""
    kinds = {"n_lines": pa.int64(), "start": pa.int32(), "n": pa.int32(), "hash": pa.int64()}

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array([r[0] for r in rows], pa.int32())
        return pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns[1:]], *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values(), 1)]],
                                          [*batch.schema.names[1:], *kinds])

    for batch in batches:
        rows = []
        for i, text in enumerate(batch.column(0)):
            lines = _split(text.as_py())
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), np.uint64, len(lines))
            rows.append((i, len(lines), None, None, None))
            rows += [(i, None, *c) for c in cut_lines(lines, hashes)]
            if len(rows) >= BATCH_CHUNKS:
                for lo in range(0, len(rows), BATCH_CHUNKS):
                    yield made(batch, rows[lo:lo + BATCH_CHUNKS])
                rows = []
        yield made(batch, rows)


def _bytes_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text and its wanted chunks -> one row per chunk with its bytes, in batches of about ``BATCH_BYTES``."""
    kinds = {"k1": pa.int64(), "k2": pa.int64(), "start": pa.int32(), "n": pa.int32(), "hash": pa.int64(), "first": pa.bool_(), "bytes": pa.binary()}
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], [*kinds])
    for batch in batches:
        rows, held = [], 0
        for text, k1, k2, wanted in zip(*[batch.column(i) for i in range(4)], strict=True):
            lines = _split(text.as_py())
            for w in wanted:
                w = w.as_py()
                rows.append((k1.as_py(), k2.as_py(), w["start"], w["n"], w["hash"], w["first"], b"\n".join(lines[w["start"]:w["start"] + w["n"]])))
                held += len(rows[-1][-1])
                if held > BATCH_BYTES or len(rows) >= BATCH_CHUNKS:
                    yield made(rows)
                    rows, held = [], 0
        yield made(rows)


def removable_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct document row: doc_id, k1, k2, copies, n_lines, removed (sorted line numbers).

    In a row that is repeated as it is, ``removed`` is for the first one; later ones repeat it.
    """
    src = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), *row_key(id_col, text_col))
    kind = src.schema["doc_id"].dataType.simpleString()
    found = stored(src.mapInArrow(_chunk_batches, f"doc_id {kind}, k1 long, k2 long, n_lines long, start int, n int, hash long"), "line-chunks")
    chunks = found.where(F.col("start").isNotNull()).drop("n_lines")
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id", *ROW_KEY, "start")
    repeated = stored(chunks.groupBy("hash").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1")
                      .select("hash", F.col("first.k1").alias("f1"), F.col("first.k2").alias("f2"), F.col("first.start").alias("fs")), "line-repeated")
    is_first = (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & (F.col("start") == F.col("fs"))
    places = chunks.join(repeated, "hash").select(*ROW_KEY, "start", "n", "hash", is_first.alias("first")).distinct()
    wanted = places.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("start", "n", "hash", "first")).alias("wanted"))
    # What repeats grows with the corpus, so it is never broadcast: one sort-merge join at every size.
    fetched = keyed_join(docs.select(F.col(id_col), F.col(text_col)), wanted.hint("merge"), "inner", id_col, text_col).select(F.col(text_col).alias("text"), F.col("_k1").alias("k1"), F.col("_k2").alias("k2"), "wanted")
    held = stored(fetched.mapInArrow(_bytes_batches, "k1 long, k2 long, start int, n int, hash long, first boolean, bytes binary"), "line-bytes")
    firsts = held.where("first").groupBy("hash").agg(F.first("bytes").alias("first_bytes"))
    later = held.where("not first").join(firsts, "hash").where(F.col("bytes") == F.col("first_bytes"))
    lines = later.select(*ROW_KEY, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("line")).distinct()
    removed = lines.groupBy(*ROW_KEY).agg(F.sort_array(F.collect_list("line")).alias("removed"))
    rows = found.where(F.col("start").isNull()).groupBy(*ROW_KEY).agg(F.first("doc_id").alias("doc_id"), F.first("n_lines").alias("n_lines"), F.count("*").alias("copies"))
    return rows.join(removed, ROW_KEY, "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removable lines taken out of the text (columns as given)."""
    gone = stored(removable_lines(docs, id_col, text_col).where(F.size("removed") > 0).select(*ROW_KEY, F.col("removed").alias("_removed")), "line-removed")
    joined = keyed_join(docs, gone, "left", id_col, text_col)
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains("_removed", i))
    text = F.when(F.col("_removed").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).select(*docs.columns)
