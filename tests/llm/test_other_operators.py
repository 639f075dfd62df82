"""Media, toxicity, quality, attribution, licenses, chat and the pipeline's stages."""

import hashlib
import json
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from cairn.llm import attribution, chat, licenses, media, quality, toxicity  # noqa: E402
from tests.oracle import DATA  # noqa: E402

TEXTS = [None, "", " ", "short", "é" * 100, "x" * 64, "line one\nline two\n", "word " * 9000, "a" * 16384 * 3]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "en" if k % 3 else None, "clash", "clash") for k, t in enumerate(texts)], "doc_id long, text string, lang string, score string, media string")


def test_media_round_trip(spark):
    df = frame(spark, TEXTS)
    rows = media.read_media(media.encode_media(df)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        p = media.text_payload(TEXTS[r.doc_id])
        assert len(p) % 64 == 0 and p and r.n_bytes == len((TEXTS[r.doc_id] or "").encode())
        assert (r.payload_sha256, r.tail_crc32, r.payload_bytes) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p))
        assert r.media_bytes % 188 == 0 and (r.gaps, r.errors, r.duplicates, r.streams) == (0, 0, 0, 1)
        assert r.units == -(-len(p) // media.UNIT) and [tuple(x) for x in r.random_access] == [(k, k * media.TICKS) for k in range(0, r.units, media.KEY_EVERY)]
    assert media.read_media(media.encode_media(df.limit(0))).count() == 0


def test_media_damage():
    data = media.mux(bytes(range(256)) * 400)
    whole = media.demux(data)
    assert b"".join(whole.streams[media.DATA_PID].units) == bytes(range(256)) * 400
    rows = [data[k : k + 188] for k in range(0, len(data), 188)]
    assert media.demux(b"junk" + data).skipped_bytes == 4
    lost = media.demux(b"".join(rows[:20] + rows[21:]))
    assert lost.gaps == 1 and lost.unit_errors == 1
    assert media.demux(b"".join(rows[:20] + rows[19:])).duplicates == 1
    bad = bytearray(data)
    bad[14] ^= 1
    assert media.demux(bytes(bad)).table_errors == 1
    assert media.demux(None).packets == 0 and media.demux(b"\x47").packets == 0
    assert media.unwrapped([media.CLOCK - 1, None, 5]) == [media.CLOCK - 1, None, media.CLOCK + 5]


def packet(pid, counter, payload, start=False, field=None, damaged=False):
    head = bytes([0x47, (0x80 if damaged else 0) | (0x40 if start else 0) | pid >> 8, pid & 0xFF])
    room = 184 - len(payload)
    if field is None and room == 0:
        return head + bytes([0x10 | counter]) + payload
    field = field or 0
    return head + bytes([0x30 | counter, room - 1]) + (bytes([field]) + b"\xff" * (room - 2) if room > 1 else b"") + payload


def test_media_of_other_muxers():
    """Tables over several packets, two sections in one, flagged packets and discontinuities."""
    streams = b"".join(bytes([6]) + (0xE000 | 0x100 + k).to_bytes(2, "big") + b"\xf0\0" for k in range(60))
    pmt = media.section(2, 1, b"\xe1\0\xf0\0" + streams)
    pat = media.section(0, 1, b"\0\1\xf0\0" + b"\0\2\xf0\1")
    other = media.section(2, 2, b"\xe1\0\xf0\0" + b"\x1b\xe3\0\xf0\0")
    out = [packet(0, 0, b"\0" + pat + b"\xff" * (183 - len(pat)), True), packet(0x1000, 0, b"\0" + pmt[:183], True), packet(0x1000, 1, pmt[183:], False)]
    out.append(packet(0x1001, 0, b"\0" + other + other + b"\xff" * 20, True))
    pes = b"\0\0\1\xe0" + (8 + 6).to_bytes(2, "big") + b"\x84\x80\5" + media.clock_bytes(77, 2) + b"unit-1"
    out += [packet(0x100, 3, pes, True, 0x40), packet(0x100, 9, pes, True, 0x80), packet(0x100, 10, b"x" * 184, damaged=True), packet(0x100, 10, pes, True, 0x40), packet(0x100, 13, pes, True)]
    got = media.demux(b"".join(out))
    assert got.programs == {1: 0x1000, 2: 0x1001} and len(got.streams) == 61 and got.table_errors == 0
    stream = got.streams[0x100]
    assert stream.units == [b"unit-1"] * 4 and stream.keys == [0, 2] and stream.times == [77] * 4
    assert (got.damaged, got.gaps) == (1, 1)
    assert media.demux(b"".join(out[:2])).table_errors == 1  # the table breaks off


def toxic_corpus(n=400):
    pick = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        bad = k % 5 == 0
        words = [f"w{chr(97 + pick.randrange(26))}{chr(97 + pick.randrange(26))}" for _ in range(40)]
        if bad:
            words[pick.randrange(40)] = pick.choice(["grobian", "lumpazius"]) + pick.choice(["", "er"])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_corpus()
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(df, lab, toxicity.fold() != 1)
    again = toxicity.train(df.repartition(7), lab, toxicity.fold() != 1)
    assert model.weights == pytest.approx(again.weights) and model.bias == pytest.approx(again.bias)
    scored = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all((scored[k] >= 0.7) == (k % 5 == 0) for k in held) and len(held) > 80
    odd = toxicity.score_toxicity(frame(spark, TEXTS), model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    kept = toxicity.drop_toxic(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, s in scored.items() if s < 0.7}
    assert toxicity.train(df, lab.limit(0), toxicity.fold() != 1).weights == {}


def test_toxicity_ties_are_not_cut(spark):
    few = [(k, f"w{k} same words in every text", "en") for k in range(60)]
    df = spark.createDataFrame(few, "doc_id long, text string, lang string")
    lab = spark.createDataFrame([(k, 1, int(k % 20 == 0)) for k in range(60)], "doc_id long, quality int, toxic int")
    assert toxicity.drop_toxic(df, lab).count() == 60  # nothing tells the three toxic texts from the others
    rows = [(k, t + " grobian" * (k % 10 == 0), x) for k, t, x in [(k, "same words in every text", "en") for k in range(300)]]
    lab = spark.createDataFrame([(k, 1, int(k % 10 < 3)) for k in range(300)], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(spark.createDataFrame(rows, df.schema), lab)  # two thirds of the toxic texts tie with the clean ones
    assert {r.doc_id for r in kept.collect()} == {k for k in range(300) if k % 10}


def test_toxicity_threshold_is_no_quota(spark):
    rows, labels = toxic_corpus(600)
    plain = dict(toxic_corpus(600)[0])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    gone = lambda frame, known: {k for k, _ in rows} - {r.doc_id for r in toxicity.drop_toxic(frame, known).collect()}
    toxic = {k for k in plain if k % 5 == 0}
    # most clean labels have no document: toxic texts are a greater share of those that do
    away = lab(labels + [(10_000 + k, 1, 0) for k in range(900)])
    assert gone(df, away) == toxic
    # half of the toxic labels mark texts that look like more clean ones: no clean text takes their place
    words = {0: " grobian", 1: " murrend", 2: " murrend", 3: " murrend"}
    rows = [(k, "same words in every text" + words.get(k % 10, "")) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert gone(df, lab([(k, 1, int(k % 10 < 2)) for k in range(400)])) == {k for k in range(400) if k % 10 == 0}


def test_toxicity_counts_do_not_depend_on_partitions(spark):
    pick = random.Random(5)
    rows = [(k, " ".join(f"w{chr(97 + pick.randrange(26))}" for _ in range(8)) + " grobian" * (k % 10 == 0)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k, _ in rows], "doc_id long, quality int, toxic int")
    one, many = (toxicity.train(df.repartition(n), lab, toxicity.fold() != 1) for n in (1, 150))
    assert one.weights.keys() == many.weights.keys() and one.weights == pytest.approx(many.weights)


def test_toxicity_of_a_small_language(spark):
    rows, labels = toxic_corpus()
    pick = random.Random(3)
    few = [(1000 + k, " ".join(f"v{chr(97 + pick.randrange(26))}" for _ in range(40)) + " schuft" * (k % 10 == 0)) for k in range(70)]
    df = spark.createDataFrame(rows + few, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [(k, 1, int("schuft" in t)) for k, t in few], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in toxicity.drop_toxic(df, lab).collect()}
    learned = [k for k, t in few if "schuft" in t and zlib.crc32(str(k).encode()) % 3 != 1]
    assert len(learned) < 8 and {k for k, _ in few} - kept == {k for k, t in few if "schuft" in t}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_on_small_tables_keeps_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert pipeline.run(spark, DATA).select("doc_id").distinct().count() > n / 2


def test_nnpu_steps_against_overfitting():
    rows = [np.array([0]), np.array([0]), np.array([1]), np.array([1, 0]), np.array([], int)]
    b, w = toxicity.fit_nnpu(rows, np.array([True, True, False, False, False]), 2, 0.3)
    assert w[0] > 0 > b


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(zip(w, w[1:], w[2:]))
    spots = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(spots), len(w) < 50 or 100 * len(spots) > 50 * len(w)


def test_quality_base_against_brute_force(spark):
    pick = random.Random(4)
    texts = TEXTS + ["a b a b a b", "x\x0by\x0cz\r\n", "l\nl\n l\n\n \nl", "é# *$ %&|<>\n" * 5]
    texts += [" ".join(pick.choice("abcdefgh") + pick.choice(["", "\n", "\t"]) for _ in range(pick.randint(1, 120))) for _ in range(60)]
    rows = quality.quality_rules(frame(spark, texts), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == base(texts[r.doc_id]), repr(texts[r.doc_id])[:80]
        assert r.kept == (not r.base_failed)  # nothing is certified without labels


def test_binomial_and_certified_cutoffs(spark):
    cases = [(0, 500, 0.005), (3, 4000, 0.005), (7, 900, 0.02), (40, 2000, 0.01), (0, 0, 0.01)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for k, n, p in cases:
        got = df.where((F.col("k") == k) & (F.col("n") == n)).select(quality.binomial_at_most(F.col("k"), F.col("n"), p).alias("x")).first().x
        want = 1.0 if k >= n * p else math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-8)
    pick = random.Random(6)
    rows, labels = [], []
    for k in range(2600):
        words = [f"w{pick.randrange(10**6)}" for _ in range(60)]
        if k % 13 == 0:
            words = [w + "$$$" for w in words]
        lang = "en" if k % 2 else None
        rows.append((k, " ".join(words), lang if k < 2500 else "xx"))
        labels.append((k, int(k % 13 > 0), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.quality_rules(df, lab).collect()}
    assert all(got[k] == (k % 13 > 0 or k >= 2500) for k in got)  # a small stratum rejects nothing
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, x in got.items() if x}


def test_attribution_rules_against_loops(spark):
    pick = random.Random(8)
    for _ in range(200):
        widths = np.array([pick.randint(1, 4) for _ in range(pick.randint(0, 12))], np.int64)
        total = int(widths.sum())
        spans = np.array([sorted(pick.randint(0, total) for _ in range(2)) for _ in range(4)])
        for rule in attribution.RULES:
            got, cut = attribution.allocate(widths, spans[:, 0], spans[:, 1], rule)
            for (b, e), c, x in zip(spans.tolist(), got, cut):
                want, at, crossing = 0.0, 0, 0
                for w in widths.tolist():
                    a, z = at, at + w
                    at = z
                    inside = max(0, min(z, e) - max(a, b))
                    want += {"start": b <= a < e, "end": b < z <= e, "fraction": inside / w}[rule] if e > b else 0
                    crossing += (a < b < z) + (a < e < z) if e > b else 0
                assert c == pytest.approx(want) and x == crossing
    path = P.path("byte_bpe_50k.tiktoken")
    for rule in attribution.RULES:
        rows = attribution.attribute_tokens(frame(spark, TEXTS), path, P.PATTERN, rule).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("d")).collect()
        assert len(rows) == len(TEXTS) and all(r.n == pytest.approx(r.d) for r in rows)
    own = spark.createDataFrame([(1, "ab cd", [("x", 0, 3), ("y", 2, 99)]), (2, "q", None)], "doc_id long, text string, s array<struct<name:string,begin:int,end:int>>")
    assert [r.section for r in attribution.attribute_tokens(own, path, P.PATTERN, spans_col="s").orderBy("doc_id", "section").collect()] == ["x", "y", None]


def test_license_scan(spark):
    t = licenses.TEMPLATES
    swapped = t["MIT-text"].replace("free of charge", "at no cost").replace("without restriction", "freely")
    texts = ["none here", None, "", "pre " * 40 + t["Apache-2.0"] + "\npost " * 3, swapped, t["GPL-3.0"].upper() + " x " + t["MIT"], "the MIT License", t["BSD"][:60]]
    rows = licenses.scan_licenses(frame(spark, texts)).collect()
    got = {(r.doc_id, r.license): r for r in rows}
    assert set(got) == {(3, "Apache-2.0"), (4, "MIT-text"), (5, "GPL-3.0"), (5, "MIT")}
    assert texts[3][got[3, "Apache-2.0"].char_begin : got[3, "Apache-2.0"].char_end] == t["Apache-2.0"]
    assert 0.85 < got[4, "MIT-text"].coverage < 1 and got[5, "MIT"].coverage == 1


def test_license_copies_short_and_whole_notices(spark):
    t = licenses.TEMPLATES
    names = ["MIT", "CC-BY-NC-4.0", "Apache-2.0"]
    texts = [(t[n] + "\n") * 3 for n in names] + ["Released under an MIT License.", t["MIT-notice"], t["BSD-3-Clause"], t["BSD-2-Clause"], t["MIT-text"]]
    rows = licenses.scan_licenses(frame(spark, texts)).collect()
    got = Counter((r.doc_id, r.license) for r in rows)
    assert got == Counter({(0, "MIT"): 3, (1, "CC-BY-NC-4.0"): 3, (2, "Apache-2.0"): 3, (3, "MIT"): 1, (4, "MIT-notice"): 1, (5, "BSD-3-Clause"): 1, (6, "BSD-2-Clause"): 1, (7, "MIT-text"): 1})
    assert {r.doc_id: r.coverage for r in rows}[3] == 0.8 and all(r.coverage == 1 for r in rows if r.doc_id != 3)
    assert all(texts[r.doc_id][r.char_begin : r.char_end] == t[r.license] for r in rows if r.doc_id < 3)


def test_winnowing_covers_shared_runs():
    pick = np.random.default_rng(1)
    words = pick.integers(1, 2**60, 50).astype(np.uint64)
    spots = {i for _, i in licenses.winnow(words)}
    need = licenses.WINDOW
    assert all(spots & set(range(i, i + need)) for i in range(len(words) - licenses.RUN + 1 - need + 1))


def test_tool_calls(spark):
    schemas = {"add": {"a": ("BIGINT", True), "note": ("STRING", False)}}
    calls = [
        ("c1", "add", '{"note": "x", "a": 1}', None), ("c2", "add", '{"a":"1"}', "c1"), ("c3", "add", "{}", "c2"), ("c4", "add", "{oops", "gone"),
        ("c5", "rm", "{}", None), ("k1", "add", '{"a":2}', "k2"), ("k2", "add", '{"a":2}', "k1"), ("k3", "add", '{"a":2}', "k1"), (None, "add", "{}", None),
        ("c1", "add", '{"note": "x", "a": 1}', None), ("s", "add", '{"a":null}', "s"), ("c6", None, None, "c3"),
    ]
    chain = [(f"n{k}", "add", '{"a":3}', f"n{k - 1}" if k else None) for k in range(70)]
    df = spark.createDataFrame(calls + chain, "call_id string, name string, arguments string, after string")
    back = spark.createDataFrame([("c1", "r2"), ("c1", "r1"), ("zz", None), (None, "x")], "call_id string, content string")
    got = {r.call_id: r for r in chat.link_calls(df, back, schemas).collect()}
    assert len(got) == 11 - 1 + 1 + 70
    assert (got["c1"].arguments, got["c1"].valid, got["c1"].status, got["c1"].n_calls, got["c1"].n_results, got["c1"].content) == ('{"a":1,"note":"x"}', True, "linked", 2, 2, "r1")
    assert got["c2"].errors == ["a is STRING"] and got["c3"].errors == ["missing a"] and got["c4"].errors == ["bad JSON"] and got["c5"].errors == ["unknown tool"]
    assert got["s"].errors == ["missing a"] and got["c6"].errors == ["unknown tool"] and got["zz"].status == "orphan" and not got["zz"].valid
    assert [got[x].depth for x in ("c1", "c2", "c3", "c4", "c6", "k1", "k2", "k3", "s")] == [0, 1, 2, 0, 3, None, None, None, None]
    assert all(got[f"n{k}"].depth == k for k in range(70))
    message = json.loads(got["c1"].message)
    assert got["c1"].message == json.dumps(message, sort_keys=True, separators=(",", ":"))
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", None), (2, 0, "system", "s"), (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in chat.link_calls(*chat.calls_of_turns(turns), chat.TURN_SCHEMAS).collect()}
    assert {k: (r.status, r.depth, r.valid) for k, r in got.items()} == {"1:0": ("linked", 0, True), "1:2": ("pending", 1, False), "2:0": ("pending", 0, True)}
    assert chat.link_calls(df.limit(0), back.limit(0), schemas).count() == 0


def test_tool_calls_against_brute_force(spark):
    pick = random.Random(12)
    schemas = {"add": {"a": ("BIGINT", True), "note": ("STRING", False, 3)}, "none": {}}
    arguments = ['{"a": 1}', '{"note":"xy", "a":{"d":1,"c":[2,{"z":1,"y":null}]}}', '{"a":2,"note":"long"}', "{", None, "{}", '{"a":"1"}']
    ids = [f"c{k}" for k in range(40)]
    calls = [(pick.choice(ids), pick.choice(["add", "none", "rm", None]), pick.choice(arguments), pick.choice([None, "gone", *ids[:15]]), pick.choice(["t1", "t2", None]), "clash") for _ in range(60)]
    results = [(pick.choice([*ids, "o1", None]), pick.choice(["r", "s", None])) for _ in range(40)]
    df = spark.createDataFrame(calls, "call_id string, name string, arguments string, after string, thread string, depth string").repartition(5)
    got = chat.link_calls(df, spark.createDataFrame(results, "call_id string, content string"), schemas).collect()
    last = lambda row: [x for v in row for x in (v is None, v or "")]
    one = {}
    for c in calls:
        if c[0] not in one or last(c[1:5]) < last(one[c[0]][1:5]):
            one[c[0]] = c
    assert {r.call_id for r in got} == set(one) | {r[0] for r in results if r[0]}
    seats = {r.call_id: r.position for r in got}
    assert sorted(seats.values()) == list(range(len(got)))

    def depth(c, seen=()):
        after = one[c][3]
        if after not in one:
            return 0
        up = None if c in seen else depth(after, (*seen, c))
        return None if up is None else up + 1

    def errors(name, text):
        if name not in schemas:
            return ["unknown tool"]
        try:
            value = json.loads(text) if text else None
        except ValueError:
            value = None
        if value is None:
            return ["bad JSON"]
        if name == "none":
            return []
        a, out = value.get("a"), []
        out += ["missing a"] if a is None else [] if isinstance(a, int) else [None]
        return out + (["note is over 3 characters"] if len(value.get("note", "")) > 3 else [])

    for r in got:
        if r.call_id not in one:
            assert r.status == "orphan" and r.position >= len(one)
            continue
        _, name, text, after, thread, _ = one[r.call_id]
        assert (r.name, r.after, r.thread, r.depth, r.n_calls) == (name, after, thread, depth(r.call_id), sum(c[0] == r.call_id for c in calls))
        want = errors(name, text)
        assert len(r.errors) == len(want) and all(w is None or w == e for w, e in zip(want, r.errors)) and r.valid == (not want)
        message = json.loads(r.message)
        assert r.message == json.dumps(message, sort_keys=True, separators=(",", ":"))
        assert message.get("arguments") == (None if not text or text == "{" else json.loads(text)) and message.get("raw_arguments") == ("{" if text == "{" else None)
        if r.depth is not None and after in one:
            assert seats[after] < r.position


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(docs, lab).count() == quality.keep_good(docs, lab).count() == toxicity.drop_toxic(docs, lab).count() == 0
    assert attribution.attribute_tokens(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == licenses.scan_licenses(docs).count() == 0


def test_rows_without_ids_and_clashing_columns(spark):
    good = " ".join(f"w{k}" for k in range(60))
    rows = [(None, 7, good, "en"), (1, 8, good, "en"), (1, 9, "short", "en"), (None, 7, None, None)]
    df = spark.createDataFrame(rows, "key long, doc_id long, text string, kept string")
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.keep_good(df, lab, id_col="key", stratum_col="kept")
    assert kept.columns == df.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, rows[:2]))
    assert sorted(map(str, map(tuple, toxicity.drop_toxic(df, lab, id_col="key").collect()))) == sorted(map(str, rows))


def test_alignment_against_all_windows():
    """Within the band, the alignment's matches are at least those of the best ungapped window and at most the common subsequence."""
    pick = random.Random(13)

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    for _ in range(200):
        template = [pick.randrange(6) for _ in range(pick.randint(3, 14))]
        words = [pick.randrange(6) for _ in range(pick.randint(1, 20))]
        shift = pick.randint(-3, 10)
        got = licenses.align(template, words, shift)
        best = 0
        for d in range(shift - licenses.BAND, shift + licenses.BAND + 1):
            score = 0
            for i, x in enumerate(template):
                if 0 <= i + d < len(words):
                    score = max(0, score + (1 if words[i + d] == x else -1))
                    best = max(best, score)
        assert (got[0] if got else 0) >= best
        if got:
            m, b, e = got
            assert m <= common(template, words[b:e]) and words[b] in template and words[e - 1] in template


def test_pipeline_steps_follow_each_other(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    pick = random.Random(9)
    rows = [(k, " ".join(f"w{pick.randrange(10**5)}" for _ in range(80)), "en", f"src{k % 3}", 0) for k in range(60)]
    rows += [(100 + k, rows[k][1] + " tail", "en", "src0", 0) for k in range(10)] + [(200, None, None, None, None), (201, "too short", "en", "s", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(range(60))
    assert len(pipeline.STAGES) == 4 and struct.calcsize("<q") == 8
