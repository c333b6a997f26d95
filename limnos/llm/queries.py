"""One query per operator of this subpackage, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.llm import chat, decontaminate, langid, linededup, maintext, merkle, mixing, neardup, pii, quality, repair, secret_scan, sharding
from limnos.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


OP1_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.s, g.n, wins.item_id FROM grams g JOIN wins ON g.n = wins.n AND g.win = wins.win),
words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id),
doc_words AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM docs),
item_words AS (
  SELECT item, n, unnest(w) AS term, generate_subscripts(w, 1) AS p
  FROM (SELECT row_number() OVER () AS item, len(w) AS n, w FROM items)),
close AS (
  SELECT DISTINCT doc_id, item, n, pos - p + e AS d, p
  FROM doc_words JOIN item_words USING (term), (SELECT unnest([-1, 0, 1]) AS e)),
near AS (
  SELECT doc_id, count(DISTINCT item) AS n_near_items
  FROM (SELECT doc_id, item, n, count(*) OVER (PARTITION BY doc_id, item, d ORDER BY p RANGE BETWEEN CURRENT ROW AND 9 FOLLOWING) AS c FROM close)
  WHERE c >= least(8, n) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(words.n_hit, 0) AS n_hit, coalesce(found.n_items, 0) AS n_items,
       sha256(coalesce(found.ids, '')) AS items_sha256, coalesce(words.n_hit, 0) > 0 AS contaminated,
       coalesce(near.n_near_items, 0) AS n_near_items
FROM docs d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""


@register("op1_decontamination", OP1_SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark phrases, exact and near, found in every document through the positional index."""
    report = decontaminate.document_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items")


@register("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document and of every raw page, from text, markup and address."""
    docs = table(spark, sf_dir, "documents")
    records = langid.document_records(docs).withColumn("page_id", F.lit(None).cast("long")).unionByName(
        langid.page_records(table(spark, sf_dir, "pages")).withColumn("doc_id", F.lit(None).cast("long")))
    found = langid.identify(records, langid.training_rows(docs))
    return found.select("doc_id", "page_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang", "declared", "host", "letters", "kept")


@register("op3_chat_formatting")
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.planted_conversation(spark))
    return chat.read_back(chat.format_turns(turns))


@register("op4_sharding")
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, through 4,096 virtual slots."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))


@register("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat a passage standing earlier in the corpus."""
    found = linededup.removable_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "copies", "n_lines", F.size("removed").cast("long").alias("n_removed"),
                        F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


@register("op6_quality_rules")
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, anomaly score and verdict of every document."""
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         F.round("score", 9).alias("score"))


@register("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base findings and what the span model adds."""
    found = pii.find_personal(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("found")).alias("spans"))


OP8_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + least(5, len(w)) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS s FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b
  WHERE 100 * shared >= 85 * (sa.n + sb.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM docs
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT docs.doc_id, coalesce(sizes.n, 0) AS n_shingles, component_id, docs.doc_id = component_id AS kept
FROM docs LEFT JOIN sizes USING (doc_id) JOIN least_id USING (doc_id)
"""


@register("op8_minhash_near_dedup", OP8_SQL)
def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents at a Jaccard similarity of 0.85."""
    groups = neardup.near_duplicate_groups(table(spark, sf_dir, "documents"), 85)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@register("op9_mixing")
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words by source weights."""
    mixed = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


@register("op10_secrets")
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, each distinct text scanned once."""
    found = secret_scan.scan_documents(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


@register("op13_conversation_repair")
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after the contract's damage, repaired with the fewest edits."""
    return repair.repair_report(repair.damage(table(spark, sf_dir, "conversations")))


@register("op12_merkle_manifest")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and folded proof of every document, some of them tampered with."""
    return merkle.manifest(merkle.leaves(table(spark, sf_dir, "documents"), {"text": merkle.tampered_text()}))


@register("op11_main_text")
def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return maintext.main_text(table(spark, sf_dir, "pages"))
