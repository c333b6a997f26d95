"""Mixing sources to target weights by pivotal dependent rounding.

A document of source s is wanted ``target_s / size_s`` times.  The whole part is
granted; the fractional parts are rounded together.  Two fractional documents
exchange word mass (probability times size), in a random direction that keeps
both expectations, until one of them is taken or dropped for good, so a source's
expected words never change.  Each bucket of documents folds to at most one
fractional residual, residuals are folded again level by level (a reduction tree
over a bounded fan-in), and what a source misses at the end is less than one
document.

Defined results: a NULL text has size 0 and is taken 0 words; sources are ranked
by code point with NULL last; repeated rows are numbered and rounded apart; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.llm.common import ROW_KEY, keyed_join, row_key, split_words, stored, uniform

FAN_IN = 64
EPS = 1e-9


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Give ``weights`` in turn to the sources in code point order, NULL last.

    The rank is counted from sorted partitions, so sources need not fit one task.
    """
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
                   .withColumn("at", F.monotonically_increasing_id()), "ranked-sources")
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    before = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn(
        "base", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = parts.withColumn("part", part).join(before, "part").withColumn("rank", F.col("base") + row)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))
    return ranked.select("source", "source_size", pick.alias("weight"))


def share_targets(sources: DataFrame, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """Add ``target``: ``share`` times all sizes, dealt by weight; what exceeds ``limit`` times a
    source's size is dealt again among the others until none is above.

    Input: source, source_size, weight.  Each round is one aggregate whose two
    sums go to the driver; capped sources stay capped.
    """
    total = sources.agg(F.sum("source_size").alias("t")).first()["t"] or 0
    level, capped = 0.0, F.lit(False)
    while True:
        sums = sources.where(~capped).agg(F.sum("weight").alias("w"), F.count("*").alias("n")).first()
        used = sources.where(capped).agg(F.sum(F.col("source_size") * F.lit(limit)).alias("u"), F.count("*").alias("n")).first()
        if not sums["n"]:
            break
        level = (share * total - (used["u"] or 0.0)) / sums["w"]
        now = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(limit)
        if sources.where(now).count() == used["n"]:
            break
        capped = now
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), F.col("source_size") * F.lit(limit)))


def _settle(pair: Column, u: Column) -> Column:
    """Two fractional members a, b -> array of both after one exchange of mass."""
    a, b = pair["a"], pair["b"]
    to_a = F.least((F.lit(1.0) - a["p"]) * a["size"], b["p"] * b["size"])
    to_b = F.least(a["p"] * a["size"], (F.lit(1.0) - b["p"]) * b["size"])
    give = F.when(u * (to_a + to_b) < to_b, to_a).otherwise(-to_b)
    return F.array(_with_p(a, a["p"] + give / a["size"]), _with_p(b, b["p"] - give / b["size"]))


def _with_p(x: Column, p: Column) -> Column:
    done = F.when(p < EPS, F.lit(0.0)).when(p > 1 - EPS, F.lit(1.0)).otherwise(p)
    return F.struct(x["key"].alias("key"), x["size"].alias("size"), done.alias("p"))


def _fold(members: Column, seed: Column, kind: str) -> Column:
    """Fold an array of fractional members: all but at most one end with p 0 or 1."""
    open_ = lambda x: (x["p"] > 0.0) & (x["p"] < 1.0)
    start = F.struct(F.lit(None).cast(kind).alias("carry"), F.array().cast(f"array<{kind}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        pair = F.struct(acc["carry"].alias("a"), x.alias("b"))
        both = _settle(pair, uniform(seed, x["key"], acc["carry"]["key"]))
        met = F.struct(F.get(F.filter(both, open_), F.lit(0)).alias("carry"),
                       F.concat(acc["out"], F.filter(both, lambda m: ~open_(m))).alias("out"))
        return F.when(acc["carry"].isNull(), F.struct(x.alias("carry"), acc["out"].alias("out"))).otherwise(met)

    return F.aggregate(members, start, step,
                       lambda acc: F.concat(acc["out"], F.filter(F.array(acc["carry"]), lambda c: c.isNotNull())))


def pivotal_round(members: DataFrame, seed: int = 17, fan_in: int = FAN_IN) -> DataFrame:
    """Round fractional members to 0 or 1.

    Input: key (unique string), stratum, size (over 0), p in (0, 1).  Returns key, copies (int).
    Members are dealt to buckets of about ``fan_in`` by a hash; a bucket is
    folded in one expression and leaves one residual, which goes up one level.
    The last residual of a stratum is rounded at random by its own probability.
    """
    kind = "struct<key:string,size:double,p:double>"
    level, done = members.select("key", "stratum", F.col("size").cast("double").alias("size"), "p"), None
    number = 0
    while True:
        counts = stored(level.groupBy("stratum").agg(F.count("*").alias("n")), "mix-counts")
        most = counts.agg(F.max("n").alias("n")).first()["n"] or 0
        if most <= 1:
            break
        number += 1
        buckets = F.ceil(F.col("n") / F.lit(fan_in))
        dealt = level.join(counts, "stratum").withColumn("bucket", F.pmod(F.xxhash64("key", F.lit(seed), F.lit(number)), buckets))
        ordered = F.sort_array(F.collect_list(F.struct(F.struct(F.xxhash64("key", F.lit(seed + number)), "key").alias("o"), F.struct("key", "size", "p").alias("m"))))
        folded = dealt.groupBy("stratum", "bucket").agg(ordered.alias("rows")).select(
            "stratum", F.explode(_fold(F.transform("rows", lambda r: r["m"]), F.lit(f"{seed}-{number}"), kind)).alias("m")).select("stratum", "m.*")
        folded = stored(folded, "mix-level")
        settled = folded.where("p = 0 OR p = 1").select("key", F.col("p").cast("int").alias("copies"))
        done = settled if done is None else done.unionByName(settled)
        level = folded.where("p > 0 AND p < 1").select("key", "stratum", "size", "p")
    rest = level.select("key", (uniform(F.lit(seed), "key", F.lit("last")) < F.col("p")).cast("int").alias("copies"))
    return rest if done is None else done.unionByName(rest)


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 17) -> DataFrame:
    """One row per document row: doc_id, k1, k2 (row key), source, size, source_size, target, copies."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *row_key(id_col, text_col),
                       F.size(split_words(text_col)).cast("long").alias("size"))
    # Repeated rows are counted and numbered again, so each has a key of its own.
    same = rows.groupBy("doc_id", "source", *ROW_KEY, "size").agg(F.count("*").alias("n"))
    rows = same.select("doc_id", "source", *ROW_KEY, "size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("occurrence"))
    rows = stored(rows.withColumn("key", F.md5(F.to_json(F.struct("doc_id", "source", *ROW_KEY, "size", "occurrence")).cast("binary"))), "mix-rows")
    sources = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    targets = stored(share_targets(cycle_weights(sources, weights), share, limit), "mix-targets")
    want = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.select("source", "source_size", "target", want.alias("want"), F.floor(want + EPS).alias("whole"), F.xxhash64("source").alias("stratum"))
    joined = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    part = F.col("want") - F.col("whole")
    fractional = joined.where((F.col("size") > 0) & (part > EPS)).select("key", "stratum", "size", part.alias("p"))
    rounded = pivotal_round(stored(fractional, "mix-fractions"), seed)
    copies = (F.col("whole") + F.coalesce("copies", F.lit(0))).cast("int")
    return (joined.join(rounded, "key", "left")
            .select("doc_id", *ROW_KEY, "source", "size", "source_size", "target", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).alias("copies")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it (columns as given)."""
    copies = mix_copies(docs, id_col, text_col, source_col, **options)
    per_key = stored(copies.groupBy(*ROW_KEY, F.col("source").alias("_source")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "mix-copies")
    joined = keyed_join(docs, per_key.where("_copies > 0"), "inner", id_col, text_col).where(F.col(source_col).eqNullSafe(F.col("_source")))
    times = lambda d: d.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
    if per_key.where("_rows > 1").isEmpty():
        return times(joined)
    # Rows repeated as they are share one key; one of them stands for all.
    again = joined.where("_rows > 1").dropDuplicates(["_k1", "_k2", "_source"])
    return times(joined.where("_rows = 1")).unionByName(times(again))
