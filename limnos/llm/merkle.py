"""Merkle manifest of a dataset, with leaf positions from bitmap ranks.

A document's position among its language's leaves is the number of smaller ids,
and it is read off a bitmap instead of a sort: per language the ids are merged
(``bit_or``, with partial merges in the tasks) into 64-bit words of which only
those with a set bit are kept, and a directory holds the number of ids before each
word.  The directory is a tree of prefix sums over 4,096 children a node, so no
window sees more, whatever the spread of the ids.  A rank is the directory entry
plus a popcount below the id's bit.

A position gives a slot array (4,096 leaves, four levels of runs of eight) and the
place in it.  Each array is reduced by itself to one digest; those are the slots
of the next round, until every language has one node, and the languages' nodes are
reduced likewise.  Proofs go the other way: each array hands the digests beside
the path down to the arrays below, and at last to the leaves.

Defined results: a NULL field is ``-``; a NULL language comes first and a NULL id
is the least; rows of the same language and id are ordered by their leaf; repeated
rows are leaves side by side; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import ascii_lower, ship_with_tasks, stored

ship_with_tasks(__name__)

# Children of a node, and bytes of a digest.
ARITY, SIZE = 8, 32
#: Levels that one slot array reduces, and so its number of slots.
LEVELS = 4
SLOTS = ARITY ** LEVELS
#: Children of a node of the popcount directory, as a power of two.
FAN_BITS = 12
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


# ---------------------------------------------------------------- digests, in tasks
def _hash(digests: bytes) -> bytes:
    return hashlib.sha256(digests.hex().encode()).digest()


def _levels(digests: bytes, n: int) -> list[bytes]:
    """Digest levels of a slot array from its slots up; ``n``: nodes of the whole tree at the slots' level."""
    levels = [digests]
    while n > 1 and len(levels) <= LEVELS:
        at = levels[-1]
        levels.append(b"".join(_hash(at[i:i + ARITY * SIZE]) for i in range(0, len(at), ARITY * SIZE)))
        n = -(-n // ARITY)
    return levels


def _beside(levels: list[bytes], slot: int) -> bytes:
    """Digests beside the path from ``slot`` to the array's top, level by level."""
    out = []
    for at in levels[:-1]:
        start, own = slot // ARITY * ARITY * SIZE, slot * SIZE
        out.append(at[start:own] + at[own + SIZE:start + ARITY * SIZE])
        slot //= ARITY
    return b"".join(out)


def fold(digest: bytes, pos: int, n: int, beside: bytes, at: int = 0) -> tuple[bytes, int]:
    """Digest at the top of a tree of ``n`` leaves, from the one at ``pos`` and what stands beside its path."""
    while n > 1:
        run, place = divmod(pos, ARITY)
        others = min(ARITY, n - run * ARITY) - 1
        cut, end = at + place * SIZE, at + others * SIZE
        digest = _hash(beside[at:cut] + digest + beside[cut:end])
        pos, n, at = run, -(-n // ARITY), end
    return digest, at


def _fill(table: pa.Table) -> pa.Table:
    """One slot array from its slots (any order): digests by place, and ids and claimed digests where given."""
    pos = table.column("pos").to_numpy() % SLOTS
    place = [0] * len(pos)
    for row, slot in enumerate(pos.tolist()):
        place[slot] = row
    table = table.take(pa.array(place))
    digests = b"".join(table.column("digest").to_pylist())
    n = table.column("n")[0].as_py()
    names = ["tree", "n", "g", "digests", "node"]
    cols = [table.column("tree").slice(0, 1), table.column("n").slice(0, 1), table.column("g").slice(0, 1),
            pa.array([digests], pa.binary()), pa.array([_levels(digests, n)[-1]], pa.binary())]
    if "doc_id" in table.column_names:
        names += ["ids", "claimed"]
        cols += [pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(table.column("claimed").to_pylist())], pa.binary())]
    return pa.table(cols, names=names)


def _hand_down(table: pa.Table) -> pa.Table:
    """What stands beside the path above each slot of one array: the array's own levels, then those above it."""
    row = table.to_pylist()[0]
    levels = _levels(row["digests"], row["n"])
    slots = range(len(row["digests"]) // SIZE)
    out = [_beside(levels, s) + row["above"] for s in slots]
    return pa.table([pa.array([row["tree"]] * len(out), pa.int32()), pa.array([row["g"] * SLOTS + s for s in slots], pa.int64()), pa.array(out, pa.binary())],
                    names=["tree", "g", "above"])


def _prove(table: pa.Table) -> pa.Table:
    """Proofs of one array of leaves, each folded to the root from the digest it is claimed to have."""
    row = table.to_pylist()[0]
    levels, above, rows = _levels(row["digests"], row["n"]), row["above"], []
    above_hex = above.hex().encode()
    for slot, doc_id in enumerate(row["ids"]):
        own, beside = slice(slot * SIZE, (slot + 1) * SIZE), _beside(levels, slot)
        proof = hashlib.sha256(beside.hex().encode())
        proof.update(above_hex)
        path = beside + above
        node, at = fold(row["claimed"][own], row["g"] * SLOTS + slot, row["n"], path)
        node, at = fold(node, row["tree"], row["n_trees"], path, at)
        rows.append((doc_id, row["digests"][own].hex(), row["subroot"], row["root"], proof.hexdigest(), node.hex(), node.hex() == row["root"]))
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


# ---------------------------------------------------------------- leaves
def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a record: each field as ``-`` or its UTF-8 byte count, a colon and itself."""
    text = [c.cast("string") for c in fields]
    return F.unhex(F.sha2(F.concat(*[F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in text]).cast("binary"), 256))


def leaves(docs: DataFrame, claimed: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, lang, digest and claimed (the digest with the columns of ``claimed`` in place of the record's own)."""
    fields = {c: F.col(c) for c in FIELDS}
    return docs.select("doc_id", "lang", leaf_digest(list(fields.values())).alias("digest"), leaf_digest(list((fields | (claimed or {})).values())).alias("claimed"))


def tampered_text() -> Column:
    """The contract's tampering: A-Z in lower case where 3 divides the id's crc32."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, ascii_lower("text")).otherwise(F.col("text"))


# ---------------------------------------------------------------- ranks
def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _before(keys: list[str], order: str, n: str) -> Column:
    """Sum of ``n`` over the rows before this one."""
    return F.coalesce(F.sum(n).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _directory(words: DataFrame) -> DataFrame:
    """``words`` (lang, w, bits, total) with ``base``, the number of rows of its language before each word."""
    low, high = words.agg(F.min("w"), F.max("w")).first()
    span = 0 if low is None else high - low
    levels = [words.select("lang", F.col("w").alias("key"), F.col("total").alias("n"))]
    while span >> FAN_BITS:
        span >>= FAN_BITS
        levels.append(stored(levels[-1].groupBy("lang", F.shiftright("key", FAN_BITS).alias("key")).agg(F.sum("n").alias("n")), "merkle-directory"))
    top = levels.pop()
    sums = top.select("lang", "key", _before(["lang"], "key", "n").alias("base"))
    while levels:
        below = levels.pop().withColumn("up", F.shiftright("key", FAN_BITS))
        below = below.select("lang", "key", "up", _before(["lang", "up"], "key", "n").alias("in_node"))
        above = sums.select(F.col("lang").alias("_lang"), F.col("key").alias("_key"), "base")
        sums = below.join(above, _same("lang", "_lang") & _same("up", "_key")).select("lang", "key", (F.col("base") + F.col("in_node")).alias("base"))
    sums = sums.select(F.col("lang").alias("_lang"), F.col("key").alias("_key"), "base")
    return words.join(sums, _same("lang", "_lang") & _same("w", "_key")).drop("_lang", "_key")


def _copies(rows: DataFrame) -> DataFrame:
    """Each row as often as its ``m`` says, ``pos`` counting up; long runs are dealt out in pieces."""
    piece = 1 << 16
    starts = rows.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(piece).cast("long"))))
    each = starts.repartition("tree", "pos", "_s").withColumn("_c", F.explode(F.sequence("_s", F.least(F.col("_s") + piece, F.col("m")) - 1)))
    return each.withColumn("pos", F.col("pos") + F.col("_c")).drop("_s", "_c", "m")


def positions(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves with tree (the language's number), n (its leaves) and pos; and the languages: lang, tree, n, n_trees."""
    w, bit = F.shiftright("doc_id", 6), F.expr("shiftleft(1L, cast(doc_id & 63 as int))")
    words = stored(found.groupBy("lang", w.alias("w")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("total")), "merkle-words")
    langs = words.groupBy("lang").agg(F.sum("total").alias("n"))
    # A row a language: a small table, numbered in one task.
    langs = langs.select("lang", (F.row_number().over(Window.orderBy(F.col("lang").asc_nulls_first())) - 1).alias("tree"), "n",
                         F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("n_trees"))
    langs = stored(langs, "merkle-langs")
    numbers = langs.select(F.col("lang").alias("_lang"), "tree", "n")
    index = _directory(words).join(numbers, _same("lang", "_lang"))
    index = stored(index.select(F.col("lang").alias("_lang"), F.col("w").alias("_w"), "bits", "base", "tree", "n",
                                (F.col("w").isNotNull() & (F.bit_count("bits") == F.col("total"))).alias("clean")), "merkle-index")
    below = F.bit_count(F.col("bits").bitwiseAND(F.expr("~shiftleft(-1L, cast(doc_id & 63 as int))")))
    met = found.withColumn("_w2", w).join(index, _same("lang", "_lang") & _same("_w2", "_w"))
    clean = met.where("clean").select("tree", "n", (F.col("base") + below).alias("pos"), "doc_id", "digest", "claimed")
    # Words with a repeated or NULL id: leaves in order of their digest, by its first 12 bits, then within those.
    some = met.where("NOT clean").groupBy("tree", "n", "_w", "base", "doc_id", "digest", "claimed").agg(F.count(F.lit(1)).alias("m"))
    some = some.withColumn("p", F.substring(F.hex("digest"), 1, 3))
    parts = some.groupBy("tree", "_w", "doc_id", "p").agg(F.sum("m").alias("s"))
    order = Window.partitionBy("tree", "_w").orderBy("doc_id", "p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("tree").alias("_t"), F.col("_w").alias("_w1"), F.col("doc_id").alias("_d"), F.col("p").alias("_p"), F.coalesce(F.sum("s").over(order), F.lit(0)).alias("ahead"))
    some = some.withColumn("inner", _before(["tree", "_w", "doc_id", "p"], "digest", "m"))
    some = some.join(parts, (F.col("tree") == F.col("_t")) & _same("_w", "_w1") & _same("doc_id", "_d") & (F.col("p") == F.col("_p")))
    some = _copies(some.select("tree", "n", (F.col("base") + F.col("ahead") + F.col("inner")).alias("pos"), "doc_id", "digest", "claimed", "m"))
    return clean.unionByName(some), langs


# ---------------------------------------------------------------- trees
def _round(slots: DataFrame, name: str) -> DataFrame:
    """Slot arrays of one round from (tree, n, pos, digest, ...)."""
    leafy = ", ids array<long>, claimed binary" if "doc_id" in slots.columns else ""
    keyed = slots.withColumn("g", F.shiftright("pos", 3 * LEVELS))
    return stored(keyed.groupBy("tree", "g").applyInArrow(_fill, f"tree int, n long, g long, digests binary, node binary{leafy}"), name)


def _reduce(slots: DataFrame) -> list[DataFrame]:
    """Rounds of slot arrays until every tree is one node."""
    rounds = [_round(slots, "merkle-leaves")]
    while rounds[-1].agg(F.max("n")).first()[0] > SLOTS:
        up = rounds[-1].where(F.col("n") > SLOTS)
        rounds.append(_round(up.select("tree", F.ceil(F.col("n") / SLOTS).cast("long").alias("n"), F.col("g").alias("pos"), F.col("node").alias("digest")), "merkle-nodes"))
    return rounds


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """tree and digest of every tree's last node."""
    return reduce(DataFrame.unionByName, [r.where(F.col("n") <= SLOTS).select("tree", F.col("node").alias("digest")) for r in rounds])


def _with_above(arrays: DataFrame, above: DataFrame) -> DataFrame:
    above = above.withColumnsRenamed({"tree": "_tree", "g": "_g"})
    return arrays.join(above, (F.col("tree") == F.col("_tree")) & (F.col("g") == F.col("_g"))).drop("_tree", "_g")


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """tree, g, above of the first round's arrays; ``tops``: tree, above of each tree's last node."""
    above = None
    for k in range(len(rounds) - 1, -1, -1):
        ends = rounds[k].where(F.col("n") <= SLOTS).select("tree", "g").join(tops, "tree").select("tree", "g", "above")
        here = ends if above is None else above.unionByName(ends)
        if k == 0:
            return here
        down = _with_above(rounds[k].select("tree", "n", "g", "digests"), here).groupBy("tree", "g")
        above = stored(down.applyInArrow(_hand_down, "tree int, g long, above binary"), "merkle-above")
    return above


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(found: DataFrame) -> DataFrame:
    """Per leaf (``leaves``): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    found = stored(found.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "digest", "claimed"), "merkle-found")
    placed, langs = positions(found)
    count = langs.agg(F.max("n_trees")).first()[0]
    if count is None:
        return found.sparkSession.createDataFrame([], RESULT)
    rounds = _reduce(placed)
    subroots = stored(_tops(rounds), "merkle-subroots")
    whole = _reduce(subroots.select(F.lit(0).alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").cast("long").alias("pos"), "digest"))
    root = _tops(whole).first()["digest"]
    top = whole[0].sparkSession.createDataFrame([(0, b"")], "tree int, above binary")
    per_tree = _with_above(whole[0].select("tree", "n", "g", "digests"), _descend(whole, top)).groupBy("tree", "g").applyInArrow(_hand_down, "tree int, g long, above binary")
    per_tree = stored(per_tree.select(F.col("g").cast("int").alias("tree"), "above"), "merkle-tops")
    above = _descend(rounds, per_tree)
    names = subroots.select(F.col("tree").alias("_s"), F.lower(F.hex("digest")).alias("subroot"))
    arrays = _with_above(rounds[0].drop("node"), above).join(names, F.col("tree") == F.col("_s")).drop("_s")
    arrays = arrays.withColumn("root", F.lit(root.hex())).withColumn("n_trees", F.lit(count))
    return arrays.groupBy("tree", "g").applyInArrow(_prove, RESULT)
