"""Brute-force checks of encoding, record files and packing."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from cairn.llm import bpe, records  # noqa: E402
from cairn.llm.byte_bpe import decode_ids, encode_ids, round_trip_digest  # noqa: E402
from cairn.llm.packing import Packer, candidates, pack, plan_cuts  # noqa: E402

RANKS, BYTES, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
ODD_TEXTS = [
    None, "", " ", "\n", "a", "a b", " a", "a ", "a  b", "a \n b", "a\n\nb", "x\ty z", "it's o'er 's 'll don't", "a b c", "a　b",
    "tab\t\ttab  end ", "é café naïve Àÿ", "İstanbul ΣΣ ẞ", "12 34a b56 7.8,9!", "<|endoftext|> x", "!!! ?? ...\n\n\n", "你好 世界。 \U0001f600 x",
    "a" * 5000, " " * 5000 + "x", "ab\n" * 2000, "word, " * 3000, "﻿bom ​zw ᠎mvs", "A.B c.d e,", "x ́y", "\x1cfs \x85nel",
]


def fuzz(n: int) -> list[str]:
    pick = random.Random(7)
    parts = [" ", " ", "\n", "a", "Word", "it's", "42", ".", ",", "é", " ", "\t", "́", "世", "'ll", "!?"]
    out = ["".join(pick.choice(parts) for _ in range(pick.randint(1, 40))) for _ in range(n)]
    parts = [" ", "\n", "a", "Word", "42", ".", ",", "é", "ÀÉ", "µª", "²", "!?", "×", "ß", "-"]
    return out + ["".join(pick.choice(parts) for _ in range(pick.randint(1, 20))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(k, "clash", t, "x") for k, t in enumerate(texts)], "doc_id long, n_tokens string, text string, start string")


def test_piece_cache_equals_library():
    from tokenizers import Tokenizer

    texts = [t or "" for t in ODD_TEXTS] + fuzz(1500)
    ranks = bpe.RankCache(RANKS, P.PATTERN, limit=50)
    for t in texts:
        assert np.frombuffer(ranks.text(t), "<u4").tolist() == ranks.codec.encode_ordinary(t), repr(t)
        assert ranks.decode(ranks.text(t)) == t.encode()
    for path, ends in ((BYTES, False), (WORDS, True)):
        own, codec = bpe.JsonCache(path, ends, limit=50), Tokenizer.from_file(path)
        codec.encode_special_tokens = True
        for t in texts:
            assert np.frombuffer(own.text(t), "<u4").tolist() == codec.encode(t, add_special_tokens=False).ids, repr(t)


def test_very_long_runs():
    ranks = bpe.rank_cache(RANKS, P.PATTERN)
    for t in (" " * 1_000_000 + "x", "a" * 300_000, "\n" * 500_000, "ab cd\n" * 200_000):
        assert ranks.decode(ranks.text(t)) == t.encode()
    for t in (" " * 9000 + "x", "a" + "\n" * 9000 + "b", "x" + " \n" * 5000, "q" + "\t" * 5000 + "1 z"):
        assert np.frombuffer(ranks.text(t), "<u4").tolist() == ranks.codec.encode_ordinary(t)


def test_round_trip_digest(spark):
    rows = round_trip_digest(frame(spark, ODD_TEXTS), RANKS, P.PATTERN).collect()
    codec = bpe.rank_cache(RANKS, P.PATTERN).codec
    assert len(rows) == len(ODD_TEXTS)
    for r in rows:
        text = ODD_TEXTS[r.doc_id] or ""
        ids = codec.encode_ordinary(text)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    back = decode_ids(encode_ids(frame(spark, ODD_TEXTS), RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.raw) for r in back} == {k: (t or "").encode() for k, t in enumerate(ODD_TEXTS)}
    assert round_trip_digest(frame(spark, []), RANKS, P.PATTERN).count() == 0


def test_records(spark, tmp_path):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(BYTES)
    codec.encode_special_tokens = True
    df = frame(spark, ODD_TEXTS).repartition(5)
    df = df.union(df.where("doc_id = 5"))  # a repeated row
    out = f"file://{tmp_path}/rec"
    manifest = records.write_shards(df, BYTES, 2, out, 50_257)
    rows = records.read_shards(spark, manifest, 50_257).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([*range(len(ODD_TEXTS)), 5])
    at = 0
    for r in rows:
        ids = [*codec.encode(ODD_TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    first = manifest[0]
    picked = records.read_at(first.uri, [first.n_records - 1, 0])
    assert picked[1][0] == 0 and picked[1][1] == np.array([2], "<u2").tobytes()
    path = first.uri.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[20] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(ValueError):
        records.read_at(first.uri, [0])
    assert records.token_records(frame(spark, []), BYTES, 2, 50_257).count() == 0


def cost_of(cuts, pos_cost, window):
    pad = lambda n: 0 if n & (n - 1) == 0 else window - n
    return sum(pad(b - a) + pos_cost[b] for a, b in zip(cuts, cuts[1:]))


def test_plan_is_optimal():
    pick = random.Random(3)
    for _ in range(150):
        window, total = pick.choice([4, 7, 16]), pick.randint(1, 40)
        pos = sorted({0, total, *(pick.randrange(total + 1) for _ in range(12))})
        pos, cost = candidates(np.array(pos[1:]), np.array([], np.int64), total, window, 1, 1.0, 5.0)
        cost = np.array([0.0] + [pick.choice([0.0, 1.0, 3.0]) for _ in pos[1:]])
        f, back = plan_cuts(pos, cost, window)
        best = {0: 0.0}
        price = dict(zip(pos.tolist(), cost.tolist()))
        for j in pos.tolist()[1:]:
            best[j] = min(best[i] + cost_of([i, j], price, window) for i in pos.tolist() if 0 < j - i <= window)
        assert [best[p] for p in pos.tolist()] == pytest.approx(f.tolist())


def test_pack(spark):
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(WORDS)
    codec.encode_special_tokens = True
    texts = ODD_TEXTS + ["some words. And more, of them! " * pick for pick in (1, 5, 50, 700, 20, 90)]
    rows = pack(frame(spark, texts).repartition(3), WORDS, 1).collect()
    check_pack(rows, {k: [*codec.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts)})
    assert pack(frame(spark, []), WORDS, 1).count() == 0


def check_pack(rows, ids):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    assert set(by) == set(ids)
    for k, v in by.items():
        at = 0
        for r in sorted(v, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[k]))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    for v in seq.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == v[0].sequence_tokens <= 2048


def test_blocks_join_up(monkeypatch):
    from cairn.llm import packing

    monkeypatch.setattr(packing, "BLOCK", 300)
    pick = random.Random(1)
    stop = np.zeros(50, bool)
    stop[7] = True
    packer, ids, rows = Packer(64, 8, 4.0, 16.0, stop, 0), {}, []
    for k in range(60):
        ids[k] = [pick.randrange(1, 50) for _ in range(pick.choice([1, 5, 40, 400]))]
        rows += packer.add(k, np.array(ids[k], "<u4"))
    rows += packer.cut(True)
    from pyspark.sql import Row

    names = [x.split()[0] for x in packing.SCHEMA.split(", ")]
    check_pack([Row(**dict(zip(names, map(int, r)))) for r in rows], ids)
