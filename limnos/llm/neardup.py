"""Near-duplicate groups by min-max hashing.

A text's shingles are hashed once per permutation, and both the least and the
greatest value are kept, so 64 permutations give 128 signature values.  Values
are banded five at a time; texts that agree on a band are candidates.

Texts with one and the same shingle set form a class first; from there on only
classes move.  Round 1 compares every class of a band bucket with the bucket's
pivot (the class with most copies).  What the pivots joined is one component;
round 2 compares *different* components of a bucket, in blocks of bounded size:
sizes and signatures first, full sets where these may reach the threshold, and it
gives out only links that join two components.  So a large group of near copies
costs one comparison per member, and a pair is left out only if it is joined
already or its signatures rule it out.  Every link is confirmed on the full sets.

With 64 permutations a pair of similarity 0.85 shares no band with probability
(1 - 0.85^5)^25 = 4e-7 (0.8: 5e-5), and a pair at the threshold agrees on too few of the
125 values more rarely still (exact binomial tail: 2e-7 below 84 values; 0.8: 1e-5 below 80).

Defined results: a NULL or wordless text has no shingles, is linked with
nothing and stays; rows with a NULL id belong to the component of their text;
repeated rows are copies; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import ROW_KEY as KEY
from limnos.llm.common import WordHashes, keyed_join, row_key, ship_with_tasks, stored
from limnos.llm.components import connected_components

ship_with_tasks(__name__)

PERMUTATIONS = 64
BAND_ROWS = 5
BANDS = 2 * PERMUTATIONS // BAND_ROWS
VALUES = BANDS * BAND_ROWS
#: Signatures that lie so many standard deviations below the threshold rule a pair out.
SIGN_SPREAD = 4.4
SHINGLE = 5
#: Bounds of a block: classes, and shingles over all of them.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000

_MULTIPLIERS = np.random.default_rng(20240229).integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, memo: WordHashes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles (A-Z lowered; a shorter text is one shingle)."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc ^= acc >> np.uint64(32)
        acc += h[i:i + n]
    acc *= np.uint64(0xD6E8FEB86659FD93)
    acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def signature(shingles: np.ndarray) -> np.ndarray:
    """125 16-bit min-max values (all minima, then maxima, less the last three)."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    most = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 512):  # blocks stay in cache
        x = _MULTIPLIERS[:, None] * shingles[None, at:at + 512]
        np.minimum(least, x.min(axis=1), out=least)
        np.maximum(most, x.max(axis=1), out=most)
    values = np.concatenate([least, most])[:VALUES]
    values ^= values >> np.uint64(31)
    values *= np.uint64(0xBF58476D1CE4E5B9)
    return (values >> np.uint64(48)).astype(np.uint16)


def fewer_agree(n: int, similarity: float) -> float:
    """Probability that fewer than ``n`` signature values agree (independent values)."""
    return sum(comb(VALUES, i) * similarity ** i * (1 - similarity) ** (VALUES - i) for i in range(n))


def least_agreement(threshold: int) -> int:
    """Signature values on which a pair at ``threshold`` per cent agrees but for chance."""
    t = threshold / 100
    cut = max(0, int(VALUES * (t - SIGN_SPREAD * (t * (1 - t) / VALUES) ** 0.5)))
    while cut and fewer_agree(cut, t) > (1 - t ** BAND_ROWS) ** BANDS:
        cut -= 1
    return cut


def band_keys(sign: np.ndarray) -> np.ndarray:
    """One 64-bit key per band."""
    rows = sign.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh3_64_intdigest(rows[b].tobytes(), b) for b in range(BANDS)], np.uint64).view(np.int64)


def _sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        sizes, digests, signs, bands = [], [], [], []
        for text in batch.column(1):
            s = shingle_set(text.as_py(), memo)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sign = signature(s) if len(s) else None
            signs.append(sign.tobytes() if len(s) else None)
            bands.append(band_keys(sign) if len(s) else None)
        made = [pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *made], ["doc_id", *KEY, "n_shingles", "class", "sign", "bands"])


def sign_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row key, n_shingles, class (digest of the shingle set), sign, bands."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row_key(id_col, text_col))
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(_sign_batches, f"doc_id {kind}, k1 long, k2 long, n_shingles long, class binary, sign binary, bands array<long>")


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = WordHashes()
    for batch in batches:
        sets = [shingle_set(t.as_py(), memo).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.large_binary())], ["class", "shingles"])


def _linked(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets reach ``threshold`` per cent similarity."""
    few, many = (x, y) if len(x) <= len(y) else (y, x)
    i = np.searchsorted(many, few)
    i[i == len(many)] = 0
    both = int(np.count_nonzero(many[i] == few))
    return 100 * both >= threshold * (len(few) + len(many) - both)


def _confirm_batches(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, own = None, None  # rows come sorted: a pivot's own row stands before its members
        for batch in batches:
            a, b = [], []
            for key, salt, member, data in zip(*[batch.column(i) for i in range(4)], strict=True):
                at = (key.as_py(), salt.as_py())
                shingles = np.frombuffer(data.as_buffer(), np.uint64)
                if member.as_py() is None:
                    pivot, own = at, shingles.copy()
                    continue
                if at != pivot:
                    raise ValueError("a member came without its pivot")
                if _linked(own, shingles, threshold):
                    a.append(at[0])
                    b.append(member.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
    return run


def confirm_pairs(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b, na, nb) whose full sets reach ``threshold`` per cent.

    Members are dealt to pivots in salted portions of about 256, each led by one copy of
    the pivot's set, and streamed past it, so memory holds one set and one batch.
    """
    enough = F.lit(100) * F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")
    pairs = stored(pairs.where(enough).select("a", "b").distinct(), "near-pairs")
    portions = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(256)).alias("portions"))
    dealt = pairs.join(portions, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("portions")))
    members = dealt.join(sets, dealt["b"] == sets["class"]).select("a", "salt", F.col("b").alias("member"), "shingles")
    leads = portions.join(sets, portions["a"] == sets["class"]).select(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("salt"), F.lit(None).cast("binary").alias("member"), "shingles")
    # Portions without a member yield a lone pivot, which is skipped.
    rows = leads.unionByName(members).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("member").asc_nulls_first())
    return rows.mapInArrow(_confirm_batches(threshold), "a binary, b binary")


def _block_batches(least: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(8)]
            for band, left, right, side, name, comp, sign, shingles in zip(*cols, strict=True):
                if (band, left, right) != at:
                    yield _block_links(at, rows, least, threshold)
                    at, rows = (band, left, right), []
                rows.append((side, name, comp, sign, shingles))
        yield _block_links(at, rows, least, threshold)
    return run


def _block_links(at: tuple | None, rows: list[tuple], least: int, threshold: int) -> pa.RecordBatch:
    """Links that join the components of one pair of blocks: at most one fewer than components.

    Pairs are compared by size and signature first, those that may reach the
    threshold on their full sets, and pairs joined by an earlier link not at all.
    A pair that agrees on several bands belongs to the first of them.
    """
    a, b = [], []
    if rows:
        sign = np.frombuffer(b"".join(r[3] for r in rows), np.uint16).reshape(len(rows), VALUES)
        root = np.unique([r[2] for r in rows], return_inverse=True)[1]
        side = np.array([r[0] for r in rows])
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        size = np.array([len(x) for x in sets])
        order = np.arange(len(rows))
        for i in order[side == 0]:
            ahead = (side == 1) if at[1] != at[2] else (order > i)
            alike = 100 * np.minimum(size, size[i]) >= threshold * np.maximum(size, size[i])
            later = np.nonzero(ahead & alike & (root != root[i]))[0]
            if not len(later):
                continue
            same = sign[later] == sign[i]
            later, same = later[(ok := same.sum(axis=1) >= least)], same[ok]
            if not len(later):
                continue
            first = same.reshape(len(later), BANDS, BAND_ROWS).all(axis=2).argmax(axis=1)
            for j in later[band_keys(sign[i])[first] == at[0]]:
                if root[i] != root[j] and _linked(sets[i], sets[j], threshold):
                    a.append(rows[i][1])
                    b.append(rows[j][1])
                    root[root == root[j]] = root[i]
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def cross_links(members: DataFrame, signs: DataFrame, sets: DataFrame, threshold: int, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Confirmed links (a, b) that join different components of a bucket.

    Input: band, class, comp, n of the members; class, sign; class, shingles.  The
    bucket's largest component is only compared with the rest, so its size
    counts once.  Both parts are cut by a hash into blocks of bounded rows and
    shingles, and each pair of blocks is one group.
    """
    per = members.groupBy("band", "comp").agg(F.count("*").alias("n"), F.sum("n").alias("w"))
    blocks = lambda n, w: F.greatest(F.ceil(n / F.lit(block)), F.ceil(w / F.lit(block_shingles))).cast("int")
    totals = per.groupBy("band").agg(F.max(F.struct("n", "comp", "w")).alias("top"), F.sum("n").alias("all"), F.sum("w").alias("weight"), F.count("*").alias("comps")).where("comps > 1")
    totals = totals.select("band", F.col("top.comp").alias("top"), blocks(F.col("top.n"), F.col("top.w")).alias("tops"),
                           blocks(F.col("all") - F.col("top.n"), F.col("weight") - F.col("top.w")).alias("others"))
    rows = members.join(totals, "band").withColumn("is_top", F.col("comp") == F.col("top"))
    own = F.pmod(F.xxhash64("class"), F.when(F.col("is_top"), F.col("tops")).otherwise(F.col("others"))).cast("int")
    rows = rows.withColumn("own", own)
    every = lambda lo, hi: F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    pair = lambda left, right, side: F.struct(left.alias("left"), right.alias("right"), F.lit(side).alias("side"))
    mine, zero = F.col("own"), F.lit(0)
    # Blocks of the rest are numbered from 0, blocks of the largest component from ``others``.
    with_rest = F.transform(every(zero, F.col("others") - 1), lambda j: F.when(j >= mine, pair(mine, j, 0)).otherwise(pair(j, mine, 1)))
    with_top = F.transform(every(F.col("others"), F.col("others") + F.col("tops") - 1), lambda j: pair(mine, j, 0))
    from_top = F.transform(every(zero, F.col("others") - 1), lambda i: pair(i, F.col("others") + mine, 1))
    dealt = rows.select("band", "class", "comp", F.explode(F.when(F.col("is_top"), from_top).otherwise(F.concat(with_rest, with_top))).alias("at"))
    dealt = dealt.join(signs, "class").join(sets, "class").select("band", "at.left", "at.right", "at.side", "class", "comp", "sign", "shingles")
    dealt = dealt.repartition("band", "left", "right").sortWithinPartitions("band", "left", "right")
    return dealt.mapInArrow(_block_batches(least_agreement(threshold), threshold), "a binary, b binary")


def class_sets(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """class, shingles for every row of ``classes`` (class and the key of one of its rows)."""
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    # The classes grow with the corpus, so they are never broadcast: one sort-merge join at every size.
    texts = texts.join(classes.hint("merge"), KEY).select("class", "text")
    sets = texts.mapInArrow(_set_batches, "class binary, shingles binary")
    return sets.groupBy("class").agg(F.first("shingles").alias("shingles"))  # the chosen row may be repeated


def near_duplicate_groups(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, k1, k2, n_shingles, class, component (a class), component_id (least doc_id)."""
    signed = stored(sign_documents(docs, id_col, text_col), "near-signed")
    classes = stored(signed.where("class IS NOT NULL").groupBy("class").agg(
        F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("sign").alias("sign"), F.first("bands").alias("bands"),
        F.min("doc_id").alias("id"), F.min(F.struct(*KEY)).alias("row")), "near-classes")
    member = classes.select("class", "n", "copies", F.explode("bands").alias("band"))
    pivots = member.groupBy("band").agg(F.count("*").alias("size"), F.max(F.struct("copies", "class", "n")).alias("p")).where("size > 1")
    shared = stored(member.join(pivots.select("band", "size", F.col("p.class").alias("pivot"), F.col("p.n").alias("np")), "band"), "near-members")
    # Full sets are needed only of classes that share a bucket.
    wanted = stored(classes.select("class", "row.*").join(shared.select("class").distinct(), "class", "left_semi"), "near-wanted")
    sets = stored(class_sets(docs, wanted, id_col, text_col), "near-sets")

    star = shared.where(F.col("class") != F.col("pivot")).select(F.col("pivot").alias("a"), F.col("class").alias("b"), F.col("np").alias("na"), F.col("n").alias("nb"))
    links = stored(confirm_pairs(star, sets, threshold), "near-links")
    found = connected_components(links).select(F.col("node").alias("class"), "component")
    # A bucket of two has no pair beyond the pivot's.
    left = shared.where("size > 2").select("band", "class", "n").join(found, "class", "left").select("band", "class", "n", F.coalesce("component", "class").alias("comp"))
    more = stored(cross_links(stored(left, "near-left"), classes.select("class", "sign"), sets, threshold), "near-links")
    joined = connected_components(links.unionByName(more)).select(F.col("node").alias("class"), "component")
    named = classes.select("class", "id").join(joined, "class", "left").select("class", "id", F.coalesce("component", "class").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("class", "component", "component_id")
    return signed.select("doc_id", *KEY, "n_shingles", "class").join(named, "class", "left").withColumn(
        "component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one of least id; wordless documents stay."""
    groups = stored(near_duplicate_groups(docs, threshold, id_col, text_col).where("class IS NOT NULL"), "near-groups")
    best = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *KEY)).alias("best"))
    marked = groups.join(best, "component").select(*KEY, ((F.col("k1") == F.col("best.k1")) & (F.col("k2") == F.col("best.k2"))).alias("stays"))
    # A row repeated as it is has one key, so of such rows one copy is taken afterwards.
    per_key = stored(marked.groupBy(*KEY).agg(F.first("stays").alias("stays"), F.count("*").alias("n")), "near-kept")
    kept = keyed_join(docs, per_key.where("NOT stays OR n > 1").select(*KEY).hint("merge"), "left_anti", id_col, text_col)
    again = per_key.where("stays AND n > 1").select(*KEY)
    if again.isEmpty():
        return kept
    once = keyed_join(docs, again, "inner", id_col, text_col).dropDuplicates(["_k1", "_k2"]).select(*docs.columns)
    return kept.unionByName(once)
