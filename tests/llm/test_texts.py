"""Language ID, chat, line dedup, quality, personal data, near duplicates and the pipeline against plain Python."""

import random
from collections import Counter, defaultdict

import brute
import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from limnos.llm import chat, langid, linededup, neardup, pii, quality
from limnos.llm.common import WordHashes, hash_sample
from limnos.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash int, class string, k1 string, kept int, `end` int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, "x", "y", 2, 3) for d, t, s in rows], SCHEMA)


def source_docs(spark):
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


LONG = " ".join(f"word{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(60_000))
EDGE = [(1, None, None), (2, "", "a"), (3, " \n\t\x0b ", "a"), (None, "a null id with some words here", None), (4, "One", "b"), (5, "one", "b"), (5, "one", "b"),
        (6, "one two THREE four", "é"), (7, "one two three four", "é"), (8, "É é", "z"), (9, LONG, "z"), (10, LONG + " tail", "z"), (11, "1.2.3.4 a@b.co", None)]


# ---------------------------------------------------------------- near duplicates
def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"
    return " ".join(out)


def families():
    rng, rows = random.Random(5), []
    for f in range(12):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(rng.randrange(30, 120))]
        rows += [edited(base, rng.randrange(0, 6), rng) for _ in range(rng.randrange(1, 18))]
    rows += rows[:10] + ["same text in many rows " * 3] * 30
    rng.shuffle(rows)
    return [(i + 100, t, "s") for i, t in enumerate(rows)]


def near(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_near_duplicates_match_all_pairs(spark):
    rows = families()
    want = brute.near_duplicates([(d, t) for d, t, _ in rows])
    assert near(neardup.near_duplicate_groups(frame(spark, rows))) == Counter((d, *v) for d, v in want.items())


def test_near_duplicates_edges(spark):
    got = near(neardup.near_duplicate_groups(frame(spark, EDGE)))
    named = brute.near_duplicates([(d, t) for d, t, _ in EDGE if d not in (5, None)] + [(5, "one")])
    want = Counter((d, *named[d]) for d, _, _ in EDGE if d is not None)
    want[None, 3, None] = 1  # seven words: three shingles; no id in its component
    assert got == want
    assert neardup.near_duplicate_groups(frame(spark, [])).count() == 0


def test_near_duplicate_query_and_one_of_each_stays(spark):
    docs = source_docs(spark)
    want = brute.near_duplicates([(d, t) for d, t, _ in docs])
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in QUERIES["op8_minhash_near_dedup"](spark, SF).collect()} == {
        d: (n, c, d == c) for d, (n, c) in want.items()}
    rows = families() + EDGE
    kept = neardup.drop_near_duplicates(frame(spark, rows), 85)
    assert kept.columns == frame(spark, []).columns
    ids = Counter(r.doc_id for r in kept.collect())
    named = brute.near_duplicates([(d, t) for d, t, _ in rows if d is not None and d != 5] + [(5, "one")])
    assert ids == Counter([d for d, (_, c) in named.items() if d == c] + [None])


@pytest.mark.parametrize("threshold", [80, 85])
def test_signatures_lose_fewer_links_than_bands(threshold):
    t = threshold / 100
    assert neardup.fewer_agree(neardup.least_agreement(threshold), t) < (1 - t ** neardup.BAND_ROWS) ** neardup.BANDS
    assert neardup.least_agreement(threshold) == {80: 80, 85: 84}[threshold]


def test_blocks_lose_no_link(spark):
    rows = families()
    memo, kept = WordHashes(), {}
    for _, t, _ in rows:
        s = neardup.shingle_set(t, memo)
        kept[s.tobytes()] = (s, neardup.signature(s))
    members, signs, sets = [], [], []
    for i, (s, sign) in enumerate(kept.values()):
        name = f"{i:04}".encode()
        signs.append((name, sign.tobytes()))
        sets.append((name, s.tobytes()))
        members += [(b, name, f"{i % 90}".encode(), len(s)) for b in neardup.band_keys(sign).tolist()]
    frames = [spark.createDataFrame(members, "band long, class binary, comp binary, n long"), spark.createDataFrame(signs, "class binary, sign binary"), spark.createDataFrame(sets, "class binary, shingles binary")]

    def groups(links):
        root = {i: i % 90 for i in range(len(kept))}
        pairs = [(int(bytes(a)), int(bytes(b))) for a, b in links]
        for a, b in pairs:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
        return root, pairs

    whole, pairs = groups(neardup.cross_links(*frames, 85).collect())
    cut, _ = groups(neardup.cross_links(*frames, 85, 4, 300).collect())
    every, _ = groups([(f"{i}".encode(), f"{j}".encode()) for i, (x, _) in enumerate(kept.values()) for j, (y, _) in enumerate(kept.values())
                       if i < j and neardup._linked(x, y, 85)])
    assert whole == cut == every and pairs


# ---------------------------------------------------------------- chat
def read_plain(turns):
    convs = defaultdict(list)
    for c, t, role, text in turns:
        convs[c].append(((t is not None, t or 0, role is not None, role or "", text is not None, text or ""), role or "", text or ""))
    out = {}
    for c, rows in convs.items():
        rows.sort(key=lambda r: r[0])
        loss = "".join(x for _, r, x in rows if r == "assistant")
        out[c] = (len(rows), brute.sha("".join(f"{r}\n{x}\n" for _, r, x in rows)), len(loss), brute.sha(loss))
    return out


HARD = ["", "\\", "\\.", "<|im_start|>", "<\\.|im_start|>", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>>", "a\nb\\n", "<s><s>", "<<s>>", "🙂é<|im_end|>\n", "[[INST]]", None]


@pytest.mark.parametrize("turns", [
    [(1, i, ["user", "assistant", None, "sys\ntem<s>"][i % 4], t) for i, t in enumerate(HARD * 2)] + [(None, None, "assistant", "x"), (2, 1, "user", "same"), (2, 1, "user", "same"), (3, 0, "assistant", "y" * 500_000)],
    []])
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.format_turns(df)).collect()}
    assert got == read_plain(turns)


def test_no_control_string_survives_in_a_text():
    roles, texts = pa.array(["user"] * len(HARD)), pa.array(HARD)
    formatted, start, end = chat.assemble(roles, texts)
    for whole, a, b, text in zip(formatted.to_pylist(), start, end, HARD, strict=True):
        inside = whole.encode()[a:b]
        assert not any(c.encode() in inside for c in chat.CONTROLS) and chat.unescape(inside).decode() == (text or "")


def test_chat_query(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    want = read_plain([*turns, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    assert {r.conv_id: tuple(r)[1:5] for r in QUERIES["op3_chat_formatting"](spark, SF).collect()} == want


# ---------------------------------------------------------------- language
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    test, train = docs.where("doc_id % 5 = 0"), docs.where("doc_id % 5 > 0")
    records = langid.document_records(test).withColumn("truth", F.col("declared")).withColumn("declared", F.lit(None).cast("string"))
    rows = langid.identify(records, langid.training_rows(train), 300).collect()
    assert sum(r.lang == r.truth for r in rows) >= 0.98 * len(rows) and all(r.kept for r in rows)


def test_host_prior_and_markup_decide_short_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    real = docs.select("text", F.col("lang").alias("declared"), F.concat("lang", F.lit(".example."), "lang").alias("host"), F.col("lang").alias("suffix"), F.lit(0).alias("id"))
    odd = spark.createDataFrame([("q", None, "fr.example.fr", "fr", 1), ("q", None, "new.example.de", "de", 2), ("q", "es", None, None, 3),
                                 ("12 !?", "en", "en.example.en", "en", 4), (None, None, None, None, 5), ("", "xx", None, None, 6)],
                                "text string, declared string, host string, suffix string, id int")
    got = {r.id: (r.lang, r.kept) for r in langid.identify(real.unionByName(odd), langid.training_rows(docs)).where("id > 0").collect()}
    assert got == {1: ("fr", True), 2: ("de", True), 3: ("es", True), 4: (None, False), 5: (None, False), 6: (None, False)}


def test_language_edges(spark):
    assert langid.keep_identified(frame(spark, [])).count() == 0
    kept = langid.keep_identified(frame(spark, EDGE))
    assert kept.columns == frame(spark, []).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 4, 5, 5, 6, 7, 8, 9, 10, 11])
    unlabelled = langid.identify(langid.document_records(frame(spark, EDGE)), langid.training_rows(frame(spark, [])))
    assert unlabelled.where("kept").count() == 0 and unlabelled.count() == len(EDGE)
    page = spark.createDataFrame([(1, "https://Blog.example.fr/x", '<html class="a" lang="FR-ca"><script>var a;</script><p>les mots</p></html>'), (2, "not a url", None)], "page_id long, url string, html string")
    got = langid.page_records(page).collect()
    assert (got[0].declared, got[0].host, got[0].suffix, got[0].text.split()) == ("fr", "blog.example.fr", "fr", ["les", "mots"])
    assert (got[1].declared, got[1].text) == (None, None)


# ---------------------------------------------------------------- line dedup
def plain_removed(rows):
    """Chunks by the operator's cuts, compared as texts, first place stays."""
    memo, places = WordHashes(), defaultdict(list)
    for d, t in rows:
        lines = linededup._split(t)
        for s, n, _ in linededup.cut_lines(lines, np.fromiter(map(memo.__getitem__, lines), np.uint64, len(lines))):
            places[tuple(lines[s:s + n])].append((d, s, n))
    gone = defaultdict(set)
    for v in places.values():
        for d, s, n in sorted(v)[1:]:
            gone[d] |= set(range(s, s + n))
    return {d: sorted(gone[d]) for d, _ in rows}


def test_line_dedup(spark):
    docs = [(d, t) for d, t, _ in source_docs(spark)]
    got = {r.doc_id: [int(x) for x in r.removed_lines.split(",") if x] for r in QUERIES["op5_line_dedup"](spark, SF).collect()}
    assert got == plain_removed(docs)


def test_repeated_passage_goes_but_for_its_first_place(spark):
    passage = [f"the line number {i} of a passage that many documents share" for i in range(12)]
    rows = [(i, "\n".join([f"own line {i} {k}" for k in range(i % 5 + 1)] + passage + [f"end {i}"]), "s") for i in range(40)]
    rows += [(99, "\n\n\n\n", "s"), (98, "\n\n\n\n", "s"), (97, None, "s"), (96, "", None), (None, None, None)]
    clean = {r.doc_id: r.text for r in linededup.remove_lines(frame(spark, rows)).collect()}
    texts = {d: t for d, t, _ in rows}
    assert clean[0] == texts[0] and all(clean[d] == texts[d] for d in (99, 98, 97, 96, None))
    for i in range(1, 40):
        left = clean[i].split("\n")
        assert [x for x in left if x not in passage] == [x for x in texts[i].split("\n") if x not in passage] and sum(x in passage for x in left) <= 4
    assert linededup.remove_lines(frame(spark, [])).count() == 0
    assert linededup.removable_lines(frame(spark, EDGE)).agg(F.sum("copies")).first()[0] == len(EDGE)


def repeated_runs(rows):
    """Lines with words in any run of over 50 words that stands earlier, by trying all runs; rows in order."""
    seen, gone = set(), {}
    for d, t in rows:
        lines, gone[d] = t.split("\n"), set()
        sizes = [len(brute.space_words(x)) for x in lines]
        for b in range(len(lines)):
            for a in range(b, -1, -1):
                if sizes[a] and sizes[b] and sum(sizes[a:b + 1]) > 50:
                    key = tuple(lines[a:b + 1])
                    if key in seen:
                        gone[d] |= set(range(a, b + 1))
                    seen.add(key)
    return gone


def test_short_passages_go_whole(spark):
    rng, rows = random.Random(11), []
    say = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[say(60 // n + rng.randrange(4)) for _ in range(n)] for n in (1, 2, 3, 4, 5) for _ in range(12)]
    passages += [[say(60), "", say(60)], [say(30), say(10), say(30)], [say(20), "", " ", say(40)], [say(2), say(55), say(1)], [say(51)], [say(1) for _ in range(80)]]
    for i in range(3 * len(passages)):
        rows.append((i, "\n".join([say(9) for _ in range(rng.randrange(3))] + passages[i % len(passages)] + [say(9) for _ in range(rng.randrange(3))])))
    want = repeated_runs(rows)
    got = {r.doc_id: set(r.removed) for r in linededup.removable_lines(frame(spark, [(d, t, "s") for d, t in rows])).collect()}
    assert got == want and sum(map(bool, want.values())) == 2 * len(passages)


def test_line_chunks_come_in_bounded_batches():
    rng = random.Random(4)
    texts = [None, "", *["\n".join(f"w{rng.randrange(10**5)} x" for _ in range(300)) for _ in range(150)], "\n".join(f"w{i} x" for i in range(40_000))]
    ids = pa.array(range(len(texts)), pa.int64())
    made = list(linededup._chunk_batches(iter([pa.RecordBatch.from_arrays([pa.array(texts), ids, ids, ids], ["text", "doc_id", *linededup.ROW_KEY])])))
    assert max(b.nbytes for b in made) < 2 << 20 < sum(b.nbytes for b in made)
    got, memo = [r for b in made for r in b.to_pylist()], WordHashes()
    assert [r["n_lines"] for r in got if r["start"] is None] == [len(linededup._split(t)) for t in texts]
    chunks = defaultdict(list)
    for r in got:
        assert r["doc_id"] == r["k1"] == r["k2"]
        if r["start"] is not None:
            chunks[r["doc_id"]].append((r["start"], r["n"], r["hash"]))
    for i, t in enumerate(texts):
        lines = linededup._split(t)
        assert chunks[i] == linededup.cut_lines(lines, np.fromiter(map(memo.__getitem__, lines), np.uint64, len(lines)))


def test_chunk_bytes_come_in_bounded_batches():
    text = "\n".join(f"{i} " + "x" * 10_000 for i in range(1000))
    wanted = [{"start": i, "n": 2, "hash": i, "first": i % 2 == 0} for i in range(999)]
    batch = pa.RecordBatch.from_arrays([pa.array([text, None]), pa.array([5, 6]), pa.array([7, 8]), pa.array([wanted, []], pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("hash", pa.int64()), ("first", pa.bool_())])))],
                                       ["text", *linededup.ROW_KEY, "wanted"])
    made = list(linededup._bytes_batches(iter([batch])))
    assert max(b.nbytes for b in made) < 9 << 20 < sum(b.nbytes for b in made)
    lines = text.encode().split(b"\n")
    want = [(5, 7, w["start"], w["n"], w["hash"], w["first"], b"\n".join(lines[w["start"]:w["start"] + 2])) for w in wanted]
    assert [tuple(r.values()) for b in made for r in b.to_pylist()] == want


def test_rows_repeated_as_they_are_keep_one_first_place(spark):
    passage = "\n".join(f"line {i} of a passage with a good many words in it" for i in range(8))
    rows = [(3, passage)] * 40 + [(7, f"own line\n{passage}")] * 30 + [(None, passage)] * 20 + [(2, f"{passage}\nend")] * 2 + [(9, None)] * 3
    docs = frame(spark, [(d, t, "s") for d, t in rows])
    got = {r.doc_id: (r.copies, r.n_lines, list(r.removed)) for r in linededup.removable_lines(docs).collect()}
    assert {d: v[:2] for d, v in got.items()} == {3: (40, 8), 7: (30, 9), None: (20, 8), 2: (2, 9), 9: (3, 0)}
    assert got[None][2] == [] and got[9][2] == [] and got[3][2] == list(range(8)) and got[7][2] == list(range(1, 9))
    assert got[2][2] == list(range(8))
    assert linededup.remove_lines(docs).count() == len(rows)


# ---------------------------------------------------------------- quality
def test_quality_counts(spark):
    memo = WordHashes()
    texts = [t for _, t, _ in source_docs(spark)] + [t for _, t, _ in EDGE] + ["a b c a b c", "a a a a", "x\nx\n\n\nx \ny #|<>", "\x00 \x85 \xa0"]
    for t in texts:
        got, want = quality.measure(t, memo), brute.quality(t)
        assert got[:5] == want[:5]
    by_id = {d: t for d, t, _ in source_docs(spark)}
    for r in QUERIES["op6_quality_rules"](spark, SF).collect():
        want = brute.quality(by_id[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want and not (r.kept and r.base_failed)


def test_quality_verdict(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels, "doc_id").where("NOT base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.7 * len(bad)


def test_quality_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality.judge(frame(spark, EDGE), labels).collect()
    assert Counter((r.doc_id, r.kept) for r in judged) == Counter((d, not brute.quality(t)[-1]) for d, t, _ in EDGE)
    assert quality.judge(frame(spark, []), labels).count() == 0
    assert quality.judge(frame(spark, [(1, None, "a")] * 3), labels).where("kept").count() == 0


# ---------------------------------------------------------------- personal data
PLANTED = ["0" * 5000 + "1.2.3.4 " + "7" * 5000 + ".1.1.1", "a@b.c_d@e.f.g", "@x.y a@@b.co x@y a@b..c", "1.2.3.4.5 256.1.1.1 001.002.003.0004 9" * 3, "4111 1111 1111 1111, 4111111111111112", "+1 (650) 555-0100 +1 2 +49-30-1234567 +++1 650 555 01 00",
           "x" * 5000 + "@", "1" * 3000, "1." * 200, "+1" + " " * 500, " ".join(map(str, range(1500))), "é@ü.de a%b+c@d-e.f-g.h"]


def test_base_spans():
    rng = random.Random(3)
    made = ["".join(rng.choice("ab1294@.+-( )_é\n") for _ in range(rng.randrange(60))) for _ in range(4000)]
    for t in PLANTED + made:
        assert sorted(pii.base_spans(t)) == sorted(brute.personal(t)), t


def test_personal_data_query(spark):
    by_id = {d: t for d, t, _ in source_docs(spark)}
    for r in QUERIES["op7_personal_data"](spark, SF).collect():
        base = sorted(((pii.KINDS.index(k), a, b) for k, a, b in brute.personal(by_id[r.doc_id])))
        said = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == brute.sha(",".join(said)) and set(said) <= set(r.spans.split(",")) | {""}
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, *_ in base) for i in range(4)]


def test_span_model_learns_boundaries_and_types(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.fit_model(docs.where("doc_id % 2 = 0"), fit_rows=200)
    right = total = extra = 0
    for r in docs.where("doc_id % 2 = 1").where(F.col("text").rlike("[0-9@]")).collect():
        for region, gold in pii.examples_of(r.text):
            spans = model._vectors(region)
            found = {(spans[k][0], spans[k][1]): y for k, y in model.best(region.n, spans)}
            right += sum(found.get(k) == y for k, y in gold.items())
            extra += sum(gold.get(k) != y for k, y in found.items())
            total += len(gold)
    assert total > 20 and right >= 0.9 * total and extra <= 0.1 * total


def test_exact_marginals_of_the_span_model():
    text = "tel +1 650 555 0100 x 4111 1111"
    model = pii.SpanModel()
    region = pii.Region(text, 4, len(text))
    spans = model._vectors(region, True)
    rng = np.random.default_rng(2)
    model.weights, model.moves = rng.normal(size=(len(model.index), 4)), rng.normal(size=(5, 5))
    spans = model._vectors(region)

    def ways(at, label):
        if at == region.n:
            yield 0.0, ()
            return
        for s, rest in ways(at + 1, 0):
            yield s + model.moves[label, 0], rest
        for k, (i, j, f) in enumerate(spans):
            if i == at:
                for y in range(4):
                    for s, rest in ways(j, y + 1):
                        yield s + model.moves[label, y + 1] + model.weights[f, y].sum(), ((k, y), *rest)

    every = list(ways(0, 0))
    z = np.logaddexp.reduce([s for s, _ in every])
    want = np.zeros((len(spans), 4))
    for s, rest in every:
        for k, y in rest:
            want[k, y] += np.exp(s - z)
    assert np.allclose(model.marginals(region.n, spans)[0], want) and model.best(region.n, spans) == list(max(every)[1])


def test_model_finds_what_the_patterns_miss(spark):
    """Held-out texts with their findings written otherwise: recall and precision of added spans."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = sorted({r.text for r in table.where(F.col("text").rlike("[0-9@]") & (F.length("text") < 20_000)).select("text").collect()})
    model = pii.SpanModel().fit([e for n, t in enumerate(texts[::2]) for e in [*pii.examples_of(t), *pii.examples_of_varied(t, n)]])
    right = wrong = missed = 0
    for n, t in enumerate(texts[1::2]):
        varied, spans = pii.varied_text(t, n)
        base = pii.base_spans(varied)
        gold, got = {s for s in spans if s not in base}, set(model.added(varied, base))
        right, wrong, missed = right + len(got & gold), wrong + len(got - gold), missed + len(gold - got)
    assert right / (right + missed) > 0.9 and right / (right + wrong) > 0.97


def test_hash_sample_of_repeated_texts(spark):
    for distinct in (1, 2, 5):
        rows = spark.range(20_000).select((F.col("id") % distinct).cast("string").alias("text"))
        assert hash_sample(rows, 400, "text").count() == 400
    assert hash_sample(spark.range(20_000), 400, "id").count() == 400


def test_rare_language_is_learned(spark):
    rows = spark.range(30_000).select(F.concat(F.lit("plain words of one kind "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("label"), "id")
    rare = spark.range(3).select(F.lit("zzqx qqzx xzqz zqxq").alias("text"), F.lit("zz").alias("label"), (F.col("id") + 50_000).alias("id"))
    names, _ = langid.fit_text_models(rows.unionByName(rare), 100)
    assert names == ["en", "zz"]


def test_redaction_and_edges(spark):
    rows = [*EDGE, *[(50 + i, t, "p") for i, t in enumerate(PLANTED)]]
    found = pii.find_personal(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    clean = {r.doc_id: r.text for r in pii.redact(frame(spark, rows)).collect()}
    assert clean[11] == "[ip] [email]" and clean[1] is None and clean[9] == LONG
    assert pii.find_personal(frame(spark, [])).count() == 0


# ---------------------------------------------------------------- pipeline
def test_pipeline_against_plain_stages(spark):
    docs = source_docs(spark)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(d, t, s) for d, t, s in docs if any(c.isalpha() for c in t or "")]
    sets = {d: brute.shingles(t) for d, t, _ in kept}
    parent = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if b < a and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((parent[a], parent[b]))
                parent = {d: low if p == high else p for d, p in parent.items()}
    kept = [x for x in kept if parent[x[0]] == x[0]]
    bad = {d for d, *_, hit in brute.decontamination([(d, t) for d, t, _ in kept], items) if hit}
    bad |= {d for d, t, _ in kept if any(brute.near(t, x) for x in dict(items).values())}
    kept = [x for x in kept if x[0] not in bad]
    rows = corpus_pipeline.run(spark, SF).collect()
    sizes, taken = defaultdict(int), Counter()
    for d, t, s in kept:
        sizes[s] += len(brute.space_words(t))
    want, times = brute.targets(sizes), Counter(r.doc_id for r in rows)
    assert set(times) <= {d for d, *_ in kept} and max(times.values()) <= 2
    for d, t, s in kept:
        taken[s] += times[d] * len(brute.space_words(t))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(len(brute.space_words(t)) for _, t, x in kept if x == s)
    loads = Counter()
    for r in rows:
        loads[r.shard] += len(r.text.encode()) + 1
    assert set(loads) <= set(range(16)) and max(loads.values()) - min(loads.values()) <= 2 * max(len(t.encode()) + 1 for _, t, _ in kept)


@pytest.mark.parametrize("rows", [EDGE, []])
def test_stages_take_odd_documents(spark, rows):
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "sharding":
            assert out.columns == docs.columns
        out.count()
        docs = out
    assert {"shard", "virtual_slot"} <= set(docs.columns)
