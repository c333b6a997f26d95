"""Benchmark decontamination with a positional inverted index of the training text.

``write_postings`` stores one posting (term, document, position) for every
training token whose term occurs in the benchmark, dealt into buckets by document:
every later intersection on a document's postings stays inside its bucket, so the
index is shuffled once, when it is built.  Exact matches: the rarest term of every
benchmark window gives candidate alignments, its second rarest term must be found
at the offset-adjusted place, and only the survivors are looked up term by term.
Near matches (8 of 10 words within one position of their place): at most two words
of a window are elsewhere, so two of its four rarest terms are near their place;
alignments on which postings of two of them agree within the slop are looked up
term by term likewise.  No benchmark window is compared with all documents.

Defined results: a NULL or wordless text has ``n_words`` 0 and no match; a NULL
``item_id`` is written as an empty string; repeated document rows each get their
row back; repeated benchmark rows count once; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limnos.llm.common import NON_WORD_CHARS, NON_WORD_CLASS, ascii_lower, keyed_join, row_key, split_words, stored
from limnos.llm.common import ROW_KEY as KEY
from limnos.session import scratch_path

WINDOW = 10
SEP_CLASS = NON_WORD_CLASS.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")  # texts are split before A-Z are lowered
SEP_CHARS = "".join(c for c in NON_WORD_CHARS if not "A" <= c <= "Z")


def _tokens(text: str) -> Column:
    return split_words(text, SEP_CLASS, SEP_CHARS)


def benchmark_terms(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item word: item (number of the distinct item row), item_id (string), len, p, term."""
    src = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.col(text_col).alias("text")).distinct()
    src = src.select("item_id", F.xxhash64("item_id", "text").alias("item"), _tokens("text").alias("words"))
    return src.select("item", "item_id", F.size("words").alias("len"), F.posexplode("words").alias("p", "term")).withColumn("term", ascii_lower("term"))


def _bucketed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared scratch folder, in buckets by row key, and read it back."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, name)
    label = "limnos_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, *KEY).write.format("parquet").bucketBy(buckets, *KEY).option("path", path).saveAsTable(label)
    return spark.table(label)


def write_postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Store the postings of ``docs`` (doc_id, k1, k2, t, pos) for the distinct ``term`` values of ``terms``; with the terms' numbers.

    A document is keyed by two hashes of its id and text, so ids may be NULL or
    repeated.  Every document also gets one posting of the empty term (number -1) at
    position ``n_words``: its length; only that one holds ``doc_id``.
    """
    vocabulary = stored(terms.select("term").distinct().withColumn("t", F.monotonically_increasing_id()).union(
        terms.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(-1).cast("long").alias("t"))), "vocabulary")
    src = docs.select(F.col(id_col).alias("doc_id"), *row_key(id_col, text_col), F.concat(_tokens(text_col), F.array(F.lit(""))).alias("words"))
    tokens = src.select("doc_id", *KEY, F.posexplode("words").alias("pos", "term")).withColumn("term", ascii_lower("term"))
    postings = tokens.join(vocabulary, "term").select(F.when(F.col("t") == -1, F.col("doc_id")).alias("doc_id"), *KEY, "t", "pos")
    return _bucketed(postings, "postings"), stored(terms.join(vocabulary, "term"), "items")


def rank_terms(terms: DataFrame, counts: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, len, and ``rank``: the positions of every window from its rarest term on (n, p, t).

    ``counts``: t, n.  A window is ``window`` consecutive words, or the whole item if it is shorter.
    """
    w = Window.partitionBy("item").orderBy("p").rowsBetween(0, window - 1)
    known = terms.join(counts, "t", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = known.withColumn("rank", F.sort_array(F.collect_list(F.struct("n", "p", "t")).over(w)))
    return ranked.where(F.size("rank") == F.least(F.lit(window), F.col("len"))).select("item", "len", "rank")


def find_matches(postings: DataFrame, terms: DataFrame, ranked: DataFrame, window: int = WINDOW) -> DataFrame:
    """Item words found in documents: k1, k2, item, item_id, pos, exact.

    ``exact``: the word at ``pos`` lies inside an occurrence of a whole window.  A window with a
    term that the corpus lacks cannot occur and is left out.
    """
    first, second = F.col("rank")[0], F.coalesce(F.get("rank", F.lit(1)), F.col("rank")[0])
    anchors = stored(ranked.where(first["n"] > 0).select("item", first["p"].alias("p1"), first["t"].alias("t1"), second["p"].alias("p2"), second["t"].alias("t2")).distinct(), "anchors")
    # Rarest term: every posting is an alignment ``diag`` of item position 0.
    aligned = (postings.join(anchors.withColumnRenamed("t1", "t"), "t")
               .select(*KEY, "item", (F.col("pos") - F.col("p1")).alias("diag"), "p1", F.col("t2").alias("t"), (F.col("pos") - F.col("p1") + F.col("p2")).alias("pos")))
    seconds = postings.join(anchors.select(F.col("t2").alias("t")).distinct(), "t", "left_semi").select(*KEY, "t", "pos")
    aligned = aligned.join(seconds, [*KEY, "t", "pos"], "left_semi").select(*KEY, "item", "diag", "p1").distinct()
    # Survivors: look up all item words within one window of the anchor.
    around = (aligned.select(*KEY, "item", "diag", F.explode(F.sequence(F.greatest(F.col("p1") - window + 1, F.lit(0)), F.col("p1") + window - 1)).alias("p"))
              .distinct().join(terms, ["item", "p"]))
    found = (_within_bucket(around.withColumn("pos", F.col("diag") + F.col("p"))).join(postings.select(*KEY, "t", "pos"), [*KEY, "t", "pos"])
             .select(*KEY, "item", "item_id", "diag", "len", "p").distinct())
    found = found.withColumn("run", F.col("p") - F.row_number().over(Window.partitionBy(*KEY, "item", "diag").orderBy("p")))
    found = found.withColumn("run_len", F.count("*").over(Window.partitionBy(*KEY, "item", "diag", "run")))
    return found.select(*KEY, "item", "item_id", (F.col("diag") + F.col("p")).alias("pos"), (F.col("run_len") >= F.least(F.lit(window), F.col("len"))).alias("exact"))


@contextmanager
def _by_bucket(spark: SparkSession) -> Iterator[None]:
    """Plans made inside may join on more keys than the buckets are dealt by without a shuffle."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _within_bucket(survivors: DataFrame) -> DataFrame:
    """The side that a lookup hashes: a bucket's survivors; its postings stream past unsorted."""
    return survivors.hint("shuffle_hash")


def near_items(postings: DataFrame, terms: DataFrame, ranked: DataFrame, window: int = WINDOW, slop: int = 1, near_words: int = 8) -> DataFrame:
    """k1, k2, item, each once: items of which an alignment puts ``near_words`` of ``window`` consecutive
    words (all words of an item of fewer) within ``slop`` positions of their place."""
    size, need = F.least(F.lit(window), F.col("len")).cast("int"), F.least(F.lit(near_words), F.col("len")).cast("int")
    # Of (missing + 2) words at least two are near their place; words the corpus lacks rank first and never are.
    anchors = stored(ranked.select("item", "len", F.explode(F.slice("rank", F.lit(1), size - need + 2)).alias("a"))
                     .select("item", "len", F.col("a.p").alias("p"), F.col("a.t").alias("t")).distinct(), "near-anchors")
    votes = postings.join(anchors, "t").select(*KEY, "item", "len", "p", (F.col("pos") - F.col("p")).alias("diag"))
    beside = Window.partitionBy(*KEY, "item").orderBy("diag").rangeBetween(-2 * slop, 2 * slop)
    agreed = votes.select("*", F.min("p").over(beside).alias("low"), F.max("p").over(beside).alias("high")).where("low <> high OR len = 1")
    around = agreed.select(*KEY, "item", "diag", F.explode(F.sequence(F.col("p") - window + 1, F.col("p") + window - 1)).alias("p")).distinct()
    around = around.join(terms.select("item", "len", "p", "t"), ["item", "p"]).withColumn("place", F.col("diag") + F.col("p"))
    # A place meets postings within 2 * slop of it: they lie in one or two spans of eight positions.
    span = lambda c: F.shiftright(c, 3)
    around = around.withColumn("span", F.explode(F.sequence(span(F.col("place") - 2 * slop), span(F.col("place") + 2 * slop))))
    met = _within_bucket(around).join(postings.select(*KEY, "t", span("pos").alias("span"), "pos"), [*KEY, "t", "span"])
    off = F.col("pos") - F.col("place")
    met = met.where(F.abs(off) <= 2 * slop).groupBy(*KEY, "item", "len", "diag").agg(
        *[F.sort_array(F.collect_set(F.when(F.abs(off - s) <= slop, F.col("p")))).alias(f"near{s + slop}") for s in range(-slop, slop + 1)])

    def whole(places: str) -> Column:
        """Do ``need`` of these item positions lie within one window?"""
        starts = F.sequence(F.lit(0), F.size(places) - need)
        return F.when(F.size(places) >= need, F.exists(starts, lambda i: F.get(places, i + need - 1) - F.get(places, i) < size)).otherwise(F.lit(False))

    near = whole("near0")
    for s in range(1, 2 * slop + 1):
        near = near | whole(f"near{s}")
    return met.where(near).select(*KEY, "item").distinct()


def document_report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: doc_id, k1, k2, n_words, n_hit, n_items, items_sha256, contaminated and n_near_items."""
    postings, terms = write_postings(docs, benchmark_terms(benchmark), id_col, text_col)
    ranked = stored(rank_terms(terms, postings.where("t >= 0").groupBy("t").agg(F.count("*").alias("n"))), "ranked")
    with _by_bucket(docs.sparkSession):
        hits = stored(find_matches(postings, terms, ranked).groupBy(*KEY).agg(
            F.size(F.collect_set(F.when(F.col("exact"), F.col("pos")))).alias("n_hit"),
            F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("items")), "hits")
        near = stored(near_items(postings, terms, ranked).groupBy(*KEY).agg(F.count("*").alias("n_near_items")), "near")
    lengths = postings.where("t = -1").select("doc_id", *KEY, F.col("pos").cast("long").alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return lengths.join(hits, KEY, "left").join(near, KEY, "left").select(
        "doc_id", *KEY, "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), F.coalesce("n_near_items", F.lit(0)).cast("long").alias("n_near_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark window, exactly or nearly (columns as given)."""
    report = document_report(docs, benchmark, id_col, text_col)
    bad = stored(report.where("contaminated OR n_near_items > 0").select(*KEY).distinct(), "contaminated")
    return keyed_join(docs, bad, "left_anti", id_col, text_col)
