"""Language identification by Bayesian evidence fusion.

Evidence per record: the likelihood of its text under byte-trigram models, the
language its markup declares, and a prior from its address.  The prior is
hierarchical: counts of a host are smoothed towards those of its address suffix,
and these towards all records.  The counts are soft (posteriors of the text
alone), summed by grouped aggregation over all records, and a record's own share
is taken out before its prior is formed.  How often a declared language agrees
with the text is estimated from the same records.

The text models are fitted on a bounded sample: the ``train_rows`` labelled
documents of least hash, whole texts.  Everything else covers all records.

Defined results: a record without letters is rejected (language NULL); NULL
declared language, host or suffix is no evidence; an empty training table rejects
everything; repeated rows are records of their own; extra columns are kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.llm.common import ROW_KEY, keyed_join, row_key, ship_with_tasks, stored

ship_with_tasks(__name__)

BITS = 16
TRAIN_ROWS = 2000
#: Of a training text so many characters count, at most.
TRAIN_CHARS = 20_000
#: A text speaks with the weight of at most so many trigrams, as its trigrams are not independent.
TEXT_WEIGHT = 60.0
#: Pseudo-counts of the level above a host or suffix.
SMOOTH = 8.0
LEAST_CONFIDENCE = 0.5

# Letters keep their (lower-case) byte, everything else in ASCII is a blank.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[65:91] = _FOLD[97:123] = np.arange(97, 123)


def _bytes(text: str) -> np.ndarray:
    """UTF-8 bytes between two blanks, so a one-letter word has a trigram."""
    return np.frombuffer(f" {text} ".encode(), np.uint8)


def _trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the trigram at every byte but the last two, and whether it holds a letter."""
    x = _FOLD[data].astype(np.uint32)
    code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
    letter = (x != 32)
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS), letter[:-2] | letter[1:-1] | letter[2:]


def _hash_cut(wanted: int, rows: int) -> int:
    """Hash below which ``wanted`` of ``rows`` rows are expected."""
    return int(min(-(2.0 ** 63) + 2.0 ** 64 * wanted / rows, 2.0 ** 63 - 1025))


def fit_text_models(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram log-probabilities, from at most ``train_rows`` rows (text, label, id).

    Every label of the table is a language, however rare: the rows are dealt out evenly
    over the labels, those of least hash first.
    """
    known = labelled.where("text IS NOT NULL AND label IS NOT NULL").select(
        F.substring("text", 1, TRAIN_CHARS).alias("text"), "label", F.xxhash64("id", "text").alias("h"))
    held = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    names = sorted(held)
    share = max(1, train_rows // max(1, len(names)))
    cut = F.create_map(*[F.lit(x) for name in names for x in (name, _hash_cut(4 * share, held[name]))]) if names else None
    near = known.where(F.col("h") <= cut[F.col("label")]).dropDuplicates(["label", "h"]).collect() if names else []
    rows = []
    for name in names:
        mine = sorted((r.h, r.text) for r in near if r.label == name)[:share]
        if not mine:  # no hash that low: all its rows are ordered
            mine = [(0, r.text) for r in known.where(F.col("label") == name).orderBy("h").limit(share).collect()]
        rows += [(text, name) for _, text in mine]
    counts = np.zeros((len(names), 1 << BITS))
    for text, label in rows:
        code, letter = _trigrams(_bytes(text))
        if len(code):
            counts[names.index(label)] += np.bincount(code[letter], minlength=1 << BITS)
    total = counts.sum(axis=1, keepdims=True)
    return names, np.log((counts + 0.05) / (total + 0.05 * (1 << BITS))).astype(np.float32)


def _score_batches(model: np.ndarray):
    table = np.ascontiguousarray(model.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(0), "")
            scores, letters = [], []
            for text in texts:
                data = _bytes(text.as_py())
                total, n = np.zeros(table.shape[1]), 0
                for at in range(0, max(len(data) - 2, 0), 1 << 20):  # blocks bound the memory of very long texts
                    code, letter = _trigrams(data[at:at + (1 << 20) + 2])
                    count = np.bincount(code[letter], minlength=1 << BITS)
                    used = np.nonzero(count)[0]
                    total += count[used] @ table[used]
                    n += int(letter.sum())
                scores.append(total * (min(1.0, TEXT_WEIGHT / n) if n else 0.0))
                letters.append(n)
            flat = pa.array(np.concatenate(scores) if scores else np.empty(0))
            offsets = pa.array(np.arange(len(scores) + 1, dtype=np.int32) * table.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.ListArray.from_arrays(offsets, flat), pa.array(letters, pa.int64())],
                                             [*batch.schema.names[1:], "text_score", "letters"])
    return run


def _softmax(scores: Column) -> Column:
    """Posterior from log scores."""
    powers = F.transform(scores, lambda v: F.exp(v - F.array_max(scores)))
    return F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def _sums(frame: DataFrame, key: str, width: int) -> DataFrame:
    """Soft counts per value of ``key``: one array of ``width`` sums."""
    return frame.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[F.sum(F.col("share")[i]) for i in range(width)]).alias(f"{key}_n"))


def _smooth(counts: Column, own: Column, above: Column) -> Column:
    """Counts without the record's own share, smoothed towards the level above; NULL counts give ``above``."""
    rest = F.zip_with(counts, own, lambda c, o: F.greatest(c - o, F.lit(0.0)))
    total = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
    return F.when(counts.isNull(), above).otherwise(F.zip_with(rest, above, lambda c, p: (c + F.lit(SMOOTH) * p) / (total + F.lit(SMOOTH))))


def identify(records: DataFrame, labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Add lang, confidence, text_lang, letters and kept to ``records``.

    ``records``: text, declared, host, suffix and columns to carry along;
    ``labelled``: text, label, id.
    """
    carried = [c for c in records.columns if c != "text"]
    names, model = fit_text_models(labelled, train_rows)
    width = len(names)
    if not width:
        none = [F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("text_lang"),
                F.lit(0).cast("long").alias("letters"), F.lit(False).alias("kept")]
        return records.select(*carried, *none)
    src = records.select("text", *carried)
    kinds = ", ".join(f"`{c}` {src.schema[c].dataType.simpleString()}" for c in carried)
    scored = src.mapInArrow(_score_batches(model), f"{kinds}, text_score array<double>, letters long")
    scored = stored(scored.withColumn("share", _softmax(F.col("text_score"))), "lang-scores")
    langs = F.array(*[F.lit(n) for n in names])
    best = lambda p: F.element_at(langs, F.array_position(p, F.array_max(p)).cast("int"))

    speaking = scored.where("letters > 0")
    overall = speaking.agg(F.array(*[F.coalesce(F.sum(F.col("share")[i]), F.lit(0.0)) for i in range(width)]).alias("n"))
    total = F.aggregate("n", F.lit(0.0), lambda a, x: a + x)
    overall = overall.select(F.transform("n", lambda c: (c + F.lit(1.0)) / (total + F.lit(float(width)))).alias("base")).first()["base"]  # one number a language
    said = _sums(speaking, "declared", width).select("declared", "declared_n")
    totals = speaking.where("declared IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("share")[i]), F.lit(0.0)).alias(f"n{i}") for i in range(width)]).first()
    per_lang = F.array(*[F.lit(float(totals[f"n{i}"])) for i in range(width)])

    joined = (scored.join(_sums(speaking, "host", width), "host", "left").join(_sums(speaking, "suffix", width), "suffix", "left").join(said, "declared", "left"))
    own = F.when(F.col("letters") > 0, F.col("share")).otherwise(F.array_repeat(F.lit(0.0), width))
    base = F.array(*[F.lit(float(v)) for v in overall])
    joined = joined.withColumn("prior", _smooth(F.col("host_n"), own, _smooth(F.col("suffix_n"), own, base)))
    agree = F.zip_with(F.zip_with("declared_n", own, lambda c, o: F.greatest(c - o, F.lit(0.0))), per_lang, lambda c, t: (c + F.lit(0.1)) / (t + F.lit(1.0)))
    agree = F.when(F.col("declared_n").isNull(), F.array_repeat(F.lit(1.0), width)).otherwise(agree)
    fused = F.zip_with(F.zip_with("text_score", "prior", lambda s, p: s + F.ln(p)), agree, lambda s, a: s + F.ln(a))
    joined = joined.withColumn("posterior", _softmax(fused))
    silent = F.col("letters") == 0
    return joined.select(
        *carried, F.when(~silent, best(F.col("posterior"))).alias("lang"),
        F.when(silent, F.lit(0.0)).otherwise(F.array_max("posterior")).alias("confidence"),
        F.when(~silent, best(F.col("share"))).alias("text_lang"), "letters",
        (~silent & (F.array_max("posterior") >= F.lit(LEAST_CONFIDENCE))).alias("kept"))


def primary_tag(c: Column) -> Column:
    """Primary subtag of a declared language (``en`` of ``en-GB``), lower case; NULL if there is none."""
    tag = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return F.when(tag != "", tag)


def document_records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared_col: str = "lang", host_col: str = "source") -> DataFrame:
    """Records of plain documents: their source stands for the host, they have no address suffix."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), primary_tag(F.col(declared_col)).alias("declared"),
                       F.col(host_col).alias("host"), F.lit(None).cast("string").alias("suffix"))


def page_records(pages: DataFrame) -> DataFrame:
    """Records of raw pages: text outside tags, the html element's language, host and last host label."""
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z-]+)""", 1)
    text = F.regexp_replace("html", r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^<>]*>", " ")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    return pages.select("page_id", text.alias("text"), primary_tag(declared).alias("declared"), host.alias("host"),
                        F.element_at(F.split(host, r"\."), -1).alias("suffix"))


def training_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    return docs.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.col(id_col).alias("id"))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents whose language cannot be told (columns as given)."""
    records = document_records(docs, id_col, text_col).select("*", *row_key())
    rejected = identify(records, training_rows(docs, id_col, text_col)).where("NOT kept").select(*ROW_KEY).distinct()
    return keyed_join(docs, stored(rejected, "lang-rejected"), "left_anti", id_col, text_col)
