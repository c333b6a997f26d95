"""Secret scans with an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its content.  The
ledger, a Parquet table in the shared folder, records which (blob, rule version)
pairs were scanned and the raw matches found.  A scan reads only pairs the
ledger lacks; findings are joined back to all paths that ever held the blob.

Matching stays in SQL functions: ``split`` gives the texts between matches and
``regexp_extract_all`` the matches, so running sums of their lengths are the
match positions.

Defined results: a NULL text counts as empty; repeated rows each get their row
back; a scan that died half-way leaves no scan record, so its pairs are scanned
again; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from limnos.llm.common import stored
from limnos.session import scratch_path


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` is the part whose length must reach ``least``; ``hint`` finds texts worth matching."""

    name: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# The three base rules, in listed order.
RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         r"(?i)(?:pass|secret|token|api_?key)"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA"),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)


def blob_of(text: str | Column) -> Column:
    """Content address: SHA-256 of the UTF-8 bytes."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _raw(rule: Rule) -> Column:
    """All matches of one rule in ``text`` as structs of lengths, in text order."""
    # Runs below the least length cannot hide a longer run of a plain character
    # class, so such a rule may ask for the length in the pattern.
    pattern = rule.pattern[:-1] + f"{{{rule.least},}}" if rule.pattern.endswith("]+") and rule.pattern.startswith("[") else rule.pattern
    zipped = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(pattern), 0).alias("hit"),
                          F.regexp_extract_all("text", F.lit(pattern), rule.group).alias("part"))
    rows = F.transform(F.filter(zipped, lambda z: z["hit"].isNotNull()), lambda z, i: F.struct(
        F.lit(rule.key).alias("rule"), i.alias("i"), F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("len"), F.length(z["part"]).alias("part")))
    due = F.array_contains("due", rule.key) & F.col("text").rlike(rule.hint)
    return F.when(due, rows).otherwise(F.array().cast("array<struct<rule:string,i:int,gap:int,len:int,part:int>>"))


class BlobLedger:
    """Which blobs were scanned by which rule versions, and what was found."""

    SCHEMA = "blob binary, rules array<string>, raw array<struct<rule:string,i:int,gap:int,len:int,part:int>>"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "secret-ledger")
        self.spark.createDataFrame([], self.SCHEMA).write.mode("append").parquet(self.path)

    def scans(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def scan(self, docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Scan the (blob, rule version) pairs of ``docs`` that the ledger lacks."""
        keys = F.array(*[F.lit(r.key) for r in rules])
        # Copies meet in the map tasks first, so a large group of copies moves once per task.
        text = F.coalesce(F.col(text_col), F.lit(""))
        blobs = docs.select(blob_of(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
        known = self.scans().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("done"))
        due = F.array_except(keys, F.coalesce("done", F.array().cast("array<string>")))
        unseen = blobs.join(known, "blob", "left").withColumn("due", due).where(F.size("due") > 0)
        unseen.select("blob", F.col("due").alias("rules"), F.concat(*[_raw(r) for r in rules]).alias("raw")).write.mode("append").parquet(self.path)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, kind, start, end (code points, end exclusive) of the given rule versions."""
        rows = self.scans().where(F.size("raw") > 0).select("blob", F.explode("raw").alias("m")).select("blob", "m.*").distinct()
        line = Window.partitionBy("blob", "rule").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(line))
        wanted = [F.when((F.col("rule") == r.key) & (F.col("part") >= r.least), F.lit(r.name)) for r in rules]
        return (rows.withColumn("kind", F.coalesce(*wanted)).where("kind IS NOT NULL")
                .select("blob", "kind", (F.col("end") - F.col("len")).cast("long").alias("start"), F.col("end").cast("long").alias("end")))


def scan_documents(docs: DataFrame, ledger: BlobLedger | None = None, id_col: str = "doc_id", text_col: str = "text",
                   rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per path version: doc_id, blob, spans (array of start, kind number, kind, end, in order)."""
    ledger = ledger or BlobLedger(docs.sparkSession)
    paths = stored(docs.select(F.col(id_col).alias("doc_id"), blob_of(text_col).alias("blob")), "secret-paths")
    ledger.scan(docs, text_col, rules)
    order = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    found = ledger.findings(rules).groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("start", order[F.col("kind")].alias("k"), "kind", "end"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,k:int,kind:string,end:bigint>>")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))
