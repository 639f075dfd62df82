"""The join against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa

from cairn.llm import jaccard, shingles
from cairn.llm.jaccard import drop_near_copies, jaccard_components


def words_of(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def set_of(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [set_of(t) for _, t in rows]
    up = {k: k for k, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 75 * len(x | y) or rows[j][0] == a:
                p, q = root(a), root(rows[j][0])
                up[max(p, q)] = min(p, q)
    return sorted((k, len(s), root(k)) for (k, _), s in zip(rows, sets))


def corpus(seed):
    pick = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: [pick.choice(vocab) for _ in range(n)]
    passage, texts = say(60), [None, "", " \n\t", "One two", "one TWO", "one two three", "\x0bone\x0ctwo\r", "É é Ü", "é É ü"]
    base = say(150)
    for _ in range(80):  # one large group of near copies around one text
        w = list(base)
        for _ in range(pick.randint(0, 9)):
            w[pick.randrange(len(w))] = pick.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(40):  # a shared passage, at many shares of the text
        texts.append(" ".join(say(pick.choice([2, 8, 15, 20, 60])) + passage))
    for _ in range(30):
        w = say(pick.choice([5, 6, 9, 30, 200]))
        texts += [" ".join(w), " ".join(w[: max(1, len(w) * pick.choice([70, 76, 80, 95]) // 100)]), " ".join(w).upper()]
    texts += [texts[20]] * 5
    pick.shuffle(texts)
    return list(enumerate(texts, 10))


def test_keys_are_those_of_words():
    texts = ["", None, "a b", "A  b\nc", "x" * 50, "é Ü", "tail ", " head"]
    got = [x.tolist() for x in shingles.batch_words(pa.array(texts, pa.string()))]
    again = {}
    for t, keys in zip(texts, got):
        w = words_of(t)
        assert len(w) == len(keys)
        for a, b in zip(w, keys):
            assert again.setdefault(a, b) == b
    assert len(set(again.values())) == len(again)


def test_long_texts_are_cut_at_words(monkeypatch):
    pick = random.Random(5)
    text = " ".join("x" * pick.choice([1, 3, 900]) + str(k) for k in range(300))
    whole = next(shingles.batch_words(pa.array([text])))
    monkeypatch.setattr(shingles, "CHUNK", 500)
    parts = [x for x in shingles.batch_words(pa.array(["a b", text, None, "c"]))]
    assert np.array_equal(parts[1], whole) and [len(x) for x in parts] == [2, 300, 0, 1]


def test_words_that_collide_in_polynomials_do_not():
    morse = "a"
    while len(morse) < 2048:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    words = [morse, other, morse[:256], other[:256], "a" * 8, "a" * 9, "a" * 16, "a\0", "a"]
    keys = np.concatenate(list(shingles.batch_words(pa.array([" ".join(words)]))))
    assert len(set(keys.tolist())) == len(words)


def test_frequent_shingles_are_counted(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED", 64)
    rows = [(k, f"common passage of six words here {' '.join(f'x{k}y{j}' for j in range(k % 7))}") for k in range(40)]
    found = jaccard.profile(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 5).collect()
    seen = {}
    for r in found:
        if r.token is not None:
            seen[r.token] = seen.get(r.token, 0) + r["count"]
    assert sorted(seen.values(), reverse=True)[:2] == [40, 40] or max(seen.values()) >= 30
    assert [r.n for r in found if r.n is not None] == [len(set_of(t)) for _, t in rows]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)
    monkeypatch.setattr(jaccard, "REPORTED", 2)
    for seed, leaf in ((1, 128), (2, 4)):
        monkeypatch.setattr(jaccard, "LEAF", leaf)
        rows = corpus(seed)
        df = spark.createDataFrame([(k, t, 9, 9) for k, t in rows], "doc_id long, text string, n long, node long").repartition(3)
        got = sorted(tuple(r) for r in jaccard_components(df).collect())
        assert got == brute(rows)


def test_cells_are_cut_exactly(spark, monkeypatch):
    """Several clusters at many distances that share a rare start: cut by pivots, down to two members."""
    for k, v in (("BLOCK", 3), ("LEAF", 2), ("PIVOTS", 3), ("THINNED", 0.9)):
        monkeypatch.setattr(jaccard, k, v)
    pick = random.Random(11)
    calls = []
    real = jaccard.voronoi
    monkeypatch.setattr(jaccard, "voronoi", lambda *a: calls.append(1) or real(*a))
    say = lambda n: [f"v{pick.randrange(300)}" for _ in range(n)]
    base, texts = say(100), []
    for _ in range(12):  # centres far from one another that keep much of one base, and copies around each
        centre = list(base)
        for i in pick.sample(range(100), pick.choice([3, 5, 8])):
            centre[i] = pick.choice(say(1))
        for _ in range(5):
            w = list(centre)
            for i in pick.sample(range(100), pick.randint(0, 4)):
                w[i] = f"q{pick.randrange(10**6)}"
            texts.append(" ".join(w))
    rows = list(enumerate(texts))
    pick.shuffle(rows)
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and calls and len({c for _, _, c in got}) > 2


def test_cells_of_ids_with_several_texts(spark):
    base = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"u{k}" for k in range(40))
    rows = [(1, base), (5, base), (5, other), (9, other + " tail"), (11, "alone here"), (11, "alone here")]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows) and {c for k, _, c in got if k < 10} == {1}


def test_shuffled_ids_and_edge_tables(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "LEAF", 3)
    rows = corpus(3)[:120]
    rows += [(10, "repeated id of another text")] + [(rows[3][0], rows[50][1]), (rows[7][0], rows[60][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard_components(df).collect()) == brute(rows)
    assert jaccard_components(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, None), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(str, jaccard_components(odd).collect())) == sorted(["Row(doc_id=None, n_shingles=2, component_id=None)", "Row(doc_id=None, n_shingles=0, component_id=None)", "Row(doc_id=3, n_shingles=2, component_id=3)"])


def test_other_columns_are_kept(spark):
    text = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(1, 77, text, "x"), (2, 78, text, "y"), (None, 79, text, "z"), (3, None, None, None), (3, 5, None, "b")], "key long, doc_id long, text string, own_id string")
    kept = drop_near_copies(df, id_col="key")
    assert kept.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in kept.collect()))) == sorted(map(str, [(1, 77, text, "x"), (None, 79, text, "z"), (3, 5, None, "b")])) or sum(r.key == 3 for r in kept.collect()) == 1
    assert drop_near_copies(df.limit(0), id_col="key").count() == 0


def test_one_of_each_group_stays(spark):
    rows = corpus(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in drop_near_copies(df.union(df)).collect())
    assert kept == sorted(k for k, _, c in brute(rows) if k == c)


def test_shuffle_files_go_with_their_plan(spark):
    import time

    from cairn.llm.scratch import stash

    store = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = store.getAllFiles()
        return {x for i in range(found.size()) if (x := found.apply(i).getName()).startswith("shuffle_")}

    before = files()
    kept, _ = stash(spark.range(1000).selectExpr("id % 100 AS k").repartition(3).groupBy("k").count(), "files")
    for _ in range(20):
        left = files() - before
        if not left:
            break
        time.sleep(0.5)
    assert not left and kept.selectExpr("sum(count)").first()[0] == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_shingles_of_rare_words_come_first(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "WORD_REPORTED", 5)
    pick = random.Random(4)
    rows = [(k, " ".join([pick.choice("abc") for _ in range(40)] + [f"x{k}y{j}" for j in range(40)])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words = jaccard.commonest(jaccard.profile(df, 5), "word", jaccard.WORDS)
    assert len(words[0]) == 3
    shared = lambda w: jaccard.prefixes(df, 5, *none, *w).groupBy("token").count().where("count > 1").count()
    assert shared(words) == 0 < shared(none)


def test_slices_lose_no_shingle(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SLICE_ROWS", 1)
    monkeypatch.setattr(jaccard, "WORD_REPORTED", 3)
    rows = corpus(5)[:150]
    got = sorted(tuple(r) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == brute(rows)
