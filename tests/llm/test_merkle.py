"""The Merkle manifest against a plain version."""

import random

import brute

from limnos.llm import merkle
from limnos.llm.queries import QUERIES

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, n int, g int, tree string, pos string, digest string"


def found(spark, rows, parts=None):
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y", "z") for r in rows], SCHEMA)
    docs = docs.repartition(parts) if parts else docs
    result = merkle.manifest(merkle.leaves(docs, {"text": merkle.tampered_text()}))
    return sorted((tuple(r) for r in result.collect()), key=repr)


def docs(rng, n, ids, langs):
    return [(ids(i), rng.choice(["a", "é", None, ""]), rng.choice(langs), rng.choice([None, 5, -3]), rng.choice(["Some Text", None, "", "ß É", f"Text {i}"])) for i in range(n)]


def test_sizes(spark):
    """Languages of every kind of size: lone leaves, whole and cut runs, several levels."""
    rng, rows = random.Random(6), []
    for k, n in enumerate((1, 2, 7, 8, 9, 63, 64, 65, 513)):
        rows += [(i * 3 + 1000 * k, *r[1:2], f"l{k}", *r[3:]) for i, r in enumerate(docs(rng, n, lambda i: i, ["x"]))]
    assert found(spark, rows) == brute.merkle(rows)


def test_one_language_and_a_lone_leaf(spark):
    rows = docs(random.Random(1), 70, lambda i: 100 - i, ["en"]) + [(5, "s", None, 1, "lone")]
    assert found(spark, rows) == brute.merkle(rows)


def test_spread_negative_repeated_and_null_ids(spark):
    rng = random.Random(2)
    rows = docs(rng, 300, lambda i: rng.choice([None, rng.randrange(-2 ** 63, 2 ** 63), rng.randrange(-50, 50), 2 ** 63 - 1, -2 ** 63]), ["en", "de", None, ""])
    rows += [rows[7]] * 40 + [(None, None, None, None, None)] * 30 + [(77, "s", "en", 1, f"v{i}") for i in range(50)] + [(9, "s", "de", 4, "A long Text " * 30_000)]
    assert found(spark, rows) == brute.merkle(rows)
    assert found(spark, rows, 9) == brute.merkle(rows)


def test_several_rounds_and_directory_levels(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "SLOTS", 8)
    monkeypatch.setattr(merkle, "FAN_BITS", 2)
    rng = random.Random(4)
    rows = docs(rng, 900, lambda i: i * 17, ["en"] * 5 + [f"l{i}" for i in range(30)])
    assert found(spark, rows) == brute.merkle(rows)


def test_long_runs_are_dealt_out(spark):
    rows = [(1, "s", "en", 1, "Same")] * 70_000 + [(0, "s", "en", 1, "a"), (2, "s", "en", 1, "b")]
    assert found(spark, rows) == brute.merkle(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_query(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*merkle.FIELDS)
    rows = [tuple(r) for r in table.collect()]
    result = sorted((tuple(r) for r in QUERIES["op12_merkle_manifest"](spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert result == brute.merkle(rows)
    assert 0 < sum(not r[6] for r in result) < len(result)
