"""Unit cases of text, structure, chunks, validation, sources, tenancy, lifecycle and streaming."""

import datetime as dt
import io
import json
import os
import random
import re
import statistics
import time
import zipfile
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import chunking, embedding, lifecycle, structure, telemetry, validation, vectorsearch
from cairn.plans import ingestion, tenancy
from cairn.schemas import document_expectations, new_users, registration_errors
from cairn.sources import files
from cairn.streaming import jobs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def pages(spark, *texts, first=1):
    return spark.createDataFrame([(1, first + k, t) for k, t in enumerate(texts)], "doc long, page int, text string")


def test_stitch_across_pages(spark):
    df = spark.createDataFrame([([(1, "The worker repairs distrib-"), (2, "uted retrieval text."), (3, " "), (4, "see Smith-"), (5, "Jones")],)], "p array<struct<page:int,text:string>>")
    got = [tuple(x) for x in df.select(T.stitch(F.col("p")).alias("x")).first().x]
    assert got == [(1, "The worker repairs distributed"), (2, "retrieval text."), (4, "see Smith-Jones")]


def test_text_functions(spark):
    assert one(spark, T.clean(F.col("t")), t="para\n\n• item") == "para\n- item"
    assert one(spark, T.clean(F.col("t")), t="multi-\nthreading state-\nOf  x\r\ny ") == "multithreading state-Of x\ny"
    assert one(spark, T.sanitize(F.col("t")), t=f" a{chr(160)}b{chr(0x200B)}\n\n\n\nc\t") == "ab\n\nc"
    assert one(spark, T.sentences(F.col("t")), t=" One. Two!  Three? ") == ["One.", "Two!", "Three?"]
    assert one(spark, T.is_broken(F.col("t")), t="[HEAD] ends bro-") and not one(spark, T.is_broken(F.col("t")), t="ends fine - ")
    assert one(spark, T.is_noise(F.col("t")), t="#" * 60) and not one(spark, T.is_noise(F.col("t")), t="#" * 30)
    assert one(spark, T.is_noise(F.col("t")), t=" ".join("abcdefghijklmnopqrstuvwxyz"))


def test_headings_and_lists(spark):
    cases = {"# Hello.": 1, "### x y": 3, "1 Introduction": 1, "2.1 Scope": 1, "Section 2 Architecture": 1, "1. Introduction": 0, "Section 2: Architecture": 0, "3 apples were eaten": 1, "EXPERIENCE": 1, "AB": 0, "A | B": 0, "Title Case": 0, "ENDS.": 0, "X" * 90: 0}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", structure.heading_level(F.col("t")).alias("n")).collect()} == cases
    rows = structure.sections(pages(spark, "intro line\n- one\nmore\n- two\n\nHEADING ONE\n\nbody a\nbody b", "tail\n\nEMPTY END")).orderBy("section").collect()
    assert [(r.heading, r.page_start, r.page_end, [(b.block_type, b.content) for b in r.blocks]) for r in rows] == [
        ("Preamble", 1, 1, [("paragraph", "intro line"), ("list_item", "- one more\n- two")]),
        ("HEADING ONE", 1, 2, [("paragraph", "body a body b"), ("paragraph", "tail")]),
        ("EMPTY END", 2, 2, []),
    ]


def test_word_pieces():
    words = [f"boundaryword{i}" for i in range(80)]
    count = chunking.COUNTERS["whitespace"]
    out = chunking.split_words(" ".join(words), 20, count)
    assert " ".join(out).split() == words and all(count(x) <= 20 for x in out)


def test_chunk_limits_and_metadata(spark):
    body = "PROJECT SUMMARY\n\n" + " ".join(f"retrievaltoken{i}" for i in range(120))
    rows = chunking.chunk_sections(structure.sections(pages(spark, body, first=3)), 40, 8).orderBy("piece").collect()
    assert len(rows) > 1 and [r.piece for r in rows] == list(range(len(rows)))
    assert all(r.token_count <= 40 and r.page_number == 3 and r.section_heading == "PROJECT SUMMARY" for r in rows)
    assert [r.is_continuation for r in rows] == [False] + [True] * (len(rows) - 1)


def test_validator_triple(spark):
    same = "Built a distributed retrieval service for documents."
    rows = [(42, 0, same), (42, 1, same), (42, 2, "Maintained the ingestion pipeline that was broken-"), (42, 3, "tiny")]
    valid, summary = validation.validate(spark.createDataFrame(rows, "doc long, chunk_index int, content string"))
    s = summary.first()
    assert (s.n_input, s.n_valid, s.n_duplicates, s.n_malformed, s.n_empty) == (4, 1, 1, 1, 1)
    assert [(r.doc, r.new_index) for r in valid.collect()] == [(42, 0)]
    near = "word " * 30
    rows = [(1, 0, near + "alpha"), (1, 1, near + "alphb"), (2, 0, near + "alpha")]
    _, summary = validation.validate(spark.createDataFrame(rows, "doc long, chunk_index int, content string"))
    assert {r.doc: r.n_duplicates for r in summary.collect()} == {1: 1, 2: 0}


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{s}\"/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>' for t, s in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_sources(spark):
    content = docx([("Overview", "Heading1"), ("Plain text", None), ("First item", "ListBullet")])
    rows = spark.createDataFrame([("a.docx", "docx", content), ("b.txt", "TXT", b"caf\xff one\r\ntwo")], "path string, file_type string, content binary")
    got = {r.path: r.text for r in files.extract(rows).collect()}
    assert "Overview" in got["a.docx"] and "- First item" in got["a.docx"] and got["b.txt"] == "caf� one\ntwo"
    cases = {b"\xff\xd8\xff\xe0": "JPG", b"\x89PNG\r\n\x1a\nx": "PNG", b"%PDF-1.7": "PDF", content: "DOCX", b"plain text": "TXT", b"": None, b"a\0b": None, b"\x01" * 50: None}
    for data, kind in cases.items():
        assert one(spark, files.sniff(F.col("c")), c=data) == kind
    assert one(spark, files.accepts(F.lit("JPG"), F.col("n")), n="x.JPEG") and not one(spark, files.accepts(F.lit("PDF"), F.col("n")), n="x.txt")


def spec_chunks(heading, blocks, limit, overlap):
    """The chunk rules, said once more and plainly: texts of one section over the limit (tokens by white space)."""
    n = lambda t: len(t.split())
    head = f"[{heading}]\n"
    room = limit - n(head)
    most = min(overlap, room // 5)
    done, now = [], []

    def tail():
        out = []
        for part in reversed(now):
            for s in reversed([x for x in re.split(r"(?<=[.!?])\s+", part.strip()) if x]):
                if n(" ".join([s, *out])) > most:
                    return " ".join(out)
                out.insert(0, s)
        return " ".join(out)

    def fit(k):
        nonlocal now
        if now and sum(map(n, now)) + k > room:
            seed = tail()
            done.append(head + "\n\n".join(now))
            now = [seed] if seed and n(seed) + k <= room else []

    for b in blocks:
        fit(n(b))
        if n(b) <= room:
            now.append(b)
            continue
        for s in re.split(r"(?<=[.!?])\s+", b):
            w = s.split()
            for piece in [" ".join(w[i : i + room]) for i in range(0, len(w), room)] if len(w) > room else [s]:
                fit(n(piece))
                now.append(piece)
    return done + [head + "\n\n".join(now)] if now else done


def test_chunks_against_the_rules():
    pick = random.Random(4)
    count = chunking.COUNTERS["whitespace"]
    for _ in range(300):
        say = lambda k: " ".join(f"w{pick.randrange(99)}" + pick.choice(["", "", ".", "!"]) for _ in range(k))
        blocks = [say(pick.choice([1, 3, 8, 20, 60])) for _ in range(pick.randint(1, 8))]
        got = chunking.SectionSplitter("Some heading", (1, 2), 14, 8, count).split([{"content": b, "page": 1, "block_type": "paragraph"} for b in blocks])
        assert [x[0] for x in got] == spec_chunks("Some heading", blocks, 14, 8)
    small, big = "small para here.", " ".join(f"w{k}." for k in range(30))
    got = chunking.SectionSplitter("H", (1, 1), 10, 2, count).split([{"content": c, "page": p, "block_type": "paragraph"} for c, p in ((small, 1), (big, 2))])
    assert got[0][0] == "[H]\nsmall para here." and got[1][1] == 2


def test_near_duplicates_by_normalised_text(spark):
    base = "The Quick Brown Fox jumps over the lazy dog, again and again, until the evening comes; and then it rests"
    rows = [(1, 0, base), (1, 1, base.upper() + "!"), (1, 2, base.replace("evening", "morning light")), (2, 0, base + "."), (2, 1, base.replace(" and then it", " and then she"))]
    rows += [(3, k, f"sentence number {k} " + "of many words that differ " * (k % 3 + 1)) for k in range(12)]
    df = spark.createDataFrame(rows, "doc long, chunk_index int, content string")
    got = {(r.doc, r.chunk_index): r.verdict for r in validation.near_duplicates(validation.judged(df)).collect()}
    kept = {}
    for doc, k, text in rows:
        key = re.sub(r"\s+", " ", text.strip().lower())
        near = any(abs(len(p) - len(key)) <= max(80, int(0.15 * len(key))) and SequenceMatcher(None, p, key).ratio() >= 0.97 for p in kept.setdefault(doc, []))
        assert got[doc, k] == ("duplicate" if near else "ok"), (doc, k)
        if not near:
            kept[doc].append(key)
    assert got[1, 1] == "duplicate"


def test_ingestion_chain(spark, tmp_path):
    body = "EXPERIENCE\n\nBuilt a distributed retrieval service for documents.\n\nMaintained many pipelines of the ingestion service for years."
    files_ = [(1, "TXT", body.encode(), 1_000), (2, "txt", b"  \n ", 0), (3, "PDF", b"%PDF", 2_000), (4, "TXT", b"tiny", None), (5, "docx", docx([("Head one", "Heading1"), ("A paragraph with enough words in it to pass.", None)]), 1_000)]
    df = spark.createDataFrame(files_, "document_id long, file_type string, content binary, uploaded_at_ms long")
    clock = iter([5_000, 7_000, 5_000, 7_000])
    for _ in range(2):  # again: the same table
        out = {r.id: r for r in ingestion.ingest(df, f"{tmp_path}/chunks", f"{tmp_path}/work", now_ms=lambda: next(clock)).select("*", F.col("metrics").cast("string").alias("m")).collect()}
        rows = spark.read.parquet(f"{tmp_path}/chunks").orderBy("document_id", "chunk_index").collect()
        assert {k: r.status for k, r in out.items()} == {1: "completed", 2: "failed", 3: "failed", 4: "failed", 5: "completed"}
        assert out[2].error_message == lifecycle.NO_TEXT and out[4].error_message == lifecycle.NO_CHUNKS and "PDF" in out[3].error_message and out[2].m is None
        m, lost = json.loads(out[1].m), json.loads(out[3].m)
        assert (m["queue_wait_duration_s"], m["worker_pipeline_duration_s"], m["upload_to_completion_duration_s"], m["chunks_count"], m["total_characters"]) == (4.0, 2.0, 6.0, 1, len(body))
        assert lost["status"] == "failed" and lost["elapsed_before_failure_s"] == 2.0
        assert [(r.document_id, r.chunk_index, r.metadata.chunk_index, len(r.embedding)) for r in rows] == [(1, 0, 0, 768), (5, 0, 0, 768)]
    docs = spark.createDataFrame([(1, "pending", None), (9, "pending", None)], "id long, status string, processing_started_at timestamp")
    assert {r.id: r.status for r in ingestion.to_processing(docs, df.select("document_id"), F.current_timestamp()).collect()} == {1: "processing", 9: "pending"}


def test_recall_of_inverted_lists_on_the_table(spark):
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        return
    from cairn.queries import QUERIES

    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows])
    ids = np.array([r.vec_id for r in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    found = {}
    for r in QUERIES["ivf_topk"](spark, folder).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    asked = ids[ids % 20 == 0]
    hits = sum(len(found.get(q, set()) & set(ids[np.argsort(-(m @ m[ids == q][0]), kind="stable")[:5]].tolist())) for q in asked.tolist())
    assert set(found) == set(asked.tolist()) and hits >= 0.9 * 5 * len(asked)


def test_inverted_lists_in_blocks_with_copies_and_rows_without_a_direction(spark, monkeypatch):
    pick = random.Random(3)
    vectors = {k: [pick.gauss(0, 1) for _ in range(8)] for k in range(400)}
    vectors |= {k: vectors[7] for k in range(100, 190)} | {k: [2 * x for x in vectors[8]] for k in range(200, 210)}
    inf, nan = float("inf"), float("nan")
    vectors |= {20: [0.0] * 8, 21: [0.0] * 8, 40: None, 41: None, 60: [nan] + [1.0] * 7, 61: [1.0] * 7 + [inf], 62: [1.0] * 7 + [None]}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").repartition(3)
    vectors = {r.vec_id: r.embedding for r in df.collect()}  # as floats
    centres = vectorsearch.fit_lists(df, lists=4)
    dot = lambda x, y: list(accumulate((p * q for p, q in zip(x, y, strict=True)), initial=0.0))[-1]

    def distance(x, y):
        if None in (x, y) or None in x or None in y or not any(x) or not any(y):
            return None
        return 1 - dot(x, y) / (dot(x, x) ** 0.5 * dot(y, y) ** 0.5)

    rank = lambda x: (x[0] is None, x[0] != x[0], x[0] if x[0] is not None and x[0] == x[0] else 0.0, x[1])
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    for block, rows, k in ((4096, df, 5), (64, df, 5), (4096, df.where("vec_id IN (3, 20, 21, 41, 60, 61, 62)"), 9)):
        monkeypatch.setattr(vectorsearch, "BLOCK", block)
        got = vectorsearch.ivf_top_k(vectorsearch.nearest_lists(rows, centres), asked, centres, k=k, probes=4).orderBy("query_id", "rank").collect()
        ids = [r.vec_id for r in rows.collect()]
        for q in range(0, 400, 20):
            want = sorted(((distance(vectors[i], vectors[q]), i) for i in ids), key=rank)[:k]
            assert [(str(r.distance), r.vec_id, r["rank"]) for r in got if r.query_id == q] == [(str(d), i, n + 1) for n, (d, i) in enumerate(want)], (block, q)


def test_tenants_see_their_own(spark):
    docs = spark.createDataFrame([(1, 5), (2, 6)], "id long, uploaded_by long")
    chunks = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "document_id long, chunk_index int")
    tenancy.declare(spark)
    assert tenancy.tenant_rows(docs, "uploaded_by").count() == 0
    with tenancy.tenant(spark, 6):
        assert [r.id for r in tenancy.tenant_rows(docs, "uploaded_by").collect()] == [2]
        assert tenancy.tenant_children(chunks, docs, "document_id", "id", "uploaded_by").count() == 2
    assert tenancy.tenant_rows(docs, "uploaded_by").count() == 0


def test_replace_is_idempotent_and_streams_resume(spark, tmp_path):
    path, landing = f"{tmp_path}/chunks", f"{tmp_path}/jobs"
    make = lambda doc, n: spark.range(n).select(F.lit(doc).cast("long").alias("document_id"), F.col("id").cast("int").alias("chunk_index"))
    for doc, n in ((1, 5), (2, 3), (1, 2), (1, 2)):
        lifecycle.replace_chunks(make(doc, n), path, buckets=2)
    assert sorted((r.document_id, r.chunk_index) for r in spark.read.parquet(path).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]
    seen = []
    process = lambda df, batch: seen.extend(r.document_id for r in df.collect())
    for k in (1, 2):
        jobs.enqueue(spark.createDataFrame([(k, "p", "TXT", 1)], jobs.JOBS), landing)
        jobs.run_jobs(jobs.job_stream(spark, landing), process, f"{tmp_path}/cp").awaitTermination()
    assert seen == [1, 2]
    events = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 0, k), s) for k, s in enumerate(["pending", "processing"])], "document_id long, ts timestamp, status string")
    assert jobs.job_states(events).first().status == "processing"
    assert jobs.rate_windows(events.withColumn("client", F.lit("a")), most=1).first().limited


def test_stage_shares_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from cairn.queries import QUERIES, SQL
    from tests.oracle import expected, rows

    lines = [(49.0, 0.05, 0.01), (9.0, 0.05, 0.09), (29.0, 0.05, 0.05), (6.0, 0.07, 0.03), (40.0, 0.02, 0.05), (2.0, 0.08, 0.06), (16.0, 0.06, 0.03), (2.0, 0.07, 0.09), (38.0, 0.07, 0.07)]
    orders = {1: lines, 2: sorted(lines), 3: sorted(lines)[::-1], 4: [(1.0, None, 0.5), (2.0, None, None)], 5: [(0.0, 0.0, 0.0)], 6: [(2e6, 1e-7, 1.0), (3.0, 0.1, 0.2)], None: [(1.0, 0.25, 0.5)]}
    columns = zip(*[(k, *r) for k, v in orders.items() for r in v], strict=True)
    pq.write_table(pa.table(dict(zip(("l_orderkey", "l_quantity", "l_tax", "l_discount"), map(list, columns), strict=True))), f"{tmp_path}/lineitem.parquet")
    got = QUERIES["stage_share_pct"](spark, str(tmp_path)).toPandas()
    exact = SQL["stage_share_pct"]  # the same in decimals
    for c in ("l_quantity", "l_tax", "l_discount"):
        exact = exact.replace(f"sum({c})", f"CAST(sum(CAST({c} AS DECIMAL(28, 10))) AS DOUBLE)")
    assert rows(got) == rows(expected(exact, str(tmp_path)))


def test_telemetry_nulls(spark):
    docs = spark.createDataFrame([(1, "completed", '{"worker_pipeline_duration_s": null, "chunks_count": 0}'), (2, "completed", '{"worker_pipeline_duration_s": 3.0, "chunks_count": 4}'), (3, "failed", "{}"), (4, "pending", None)], "id long, status string, m string")
    docs = docs.select("id", "status", F.parse_json("m").alias("metrics"))
    s = telemetry.summary(docs).first()
    assert (s.total, s.runs_with_metrics, s.avg_worker_s, s.median_worker_s, s.min_worker_s, s.total_chunks, s.avg_e2e_s) == (4, 2, 1.5, 1.5, 0.0, 4, None)
    assert [(r.id, r.chunks_count) for r in telemetry.history(docs).collect()] == [(4, None), (3, None), (2, 4), (1, None)]


def test_medians_against_python(spark):
    rng = random.Random(3)
    cases = {"odd": [rng.random() for _ in range(4001)], "even": [rng.gauss(0, 9) for _ in range(3000)], "ties": [1.0] * 2000 + [2.0] * 2000 + [9.5], "two": [1.0, 2.00013], "one": [7.123456], "split": [1.0] * 50 + [2.5] * 50, "none": []}
    rows = [tuple(v[k] if k < len(v) else None for v in cases.values()) for k in range(4001)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, ", ".join(f"{k} double" for k in cases))
    got = telemetry.medians(df, {k: F.col(k) for k in cases}).first().asDict()
    want = {k: None if not v else statistics.median(v) if len(v) % 2 else round(statistics.median(v), 4) for k, v in cases.items()}
    assert got == want
    assert telemetry.medians(df.limit(0), {k: F.col(k) for k in cases}).collect() == [tuple([None] * len(cases))]


def test_lifecycle_and_expectations(spark):
    now = F.expr("TIMESTAMP '2024-01-01 01:00:00'")
    docs = spark.createDataFrame([(1, "processing", dt.datetime(2024, 1, 1), None), (2, "processing", None, None), (3, "pending", dt.datetime(2024, 1, 1), None)], "id long, status string, processing_started_at timestamp, error_message string")
    assert {r.id: r.status for r in lifecycle.sweep(docs, now).collect()} == {1: "failed", 2: "processing", 3: "pending"}
    rows = spark.createDataFrame([("n", "ab", "password", "e@x.org", None), ("n", "abc", "password", "f@x.org", "1"), ("n", "abcd", "password", "no mail", "1")], "name string, username string, password string, email string, contact_no string")
    assert [r.x for r in rows.select(registration_errors(rows).alias("x")).collect()] == [["username"], [], ["email"]]
    assert new_users(rows, spark.createDataFrame([("abc", "q")], "username string, email string")).count() == 2
    assert not one(spark, document_expectations()["file_type_ok"], file_type="EXE")


def test_staged_ids_are_dense_and_depend_on_paths_alone(spark):
    paths = [f"p{k}" for k in range(500)] + ["p7", None, None]
    def staged(names):
        return lifecycle.stage(spark.createDataFrame([(p, "clash") for p in names], "storage_path string, status string").repartition(7), 40).collect()

    rows = staged(paths)
    assert sorted(r.id for r in rows) == list(range(41, 41 + len(paths))) and {r.status for r in rows} == {"pending"}
    assert sorted((r.storage_path or "", r.id) for r in rows) == sorted((r.storage_path or "", r.id) for r in staged(paths[::-1]))
    assert staged([]) == []


def test_noise_counts_letters_standing_alone(spark):
    texts = ["a b c d e f g h i j k " + "word " * 12, "a b c d e f g h " + "word " * 20, "é ü a b c d e f\u00a0g h. i, " + "word " * 10, "x" * 40, "", None, "... " * 12, "a1 b 2 c " * 8]

    def noise(t):
        if t is None or len(t) < 40:
            return None if t is None else False
        w = t.split()
        spaced = len(w) >= 20 and sum(len(x) == 1 and x.isalpha() for x in w) / len(w) > 0.40
        return t.count("\ufffd") >= 3 or sum(x.isalnum() for x in t) / len(t) < 0.35 or spaced

    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.orderBy("k").select(T.is_noise(F.col("t")).alias("x"), T.token_count(F.col("t")).alias("n")).collect()
    assert [r.x for r in got][:5] + [r.x for r in got][6:] == [noise(t) for t in texts][:5] + [noise(t) for t in texts][6:]
    assert [r.n for r in got] == [None if t is None else len(t.split()) for t in texts]


def test_sparse_pages_paths_and_names(spark, tmp_path):
    def scan(page):
        if page == 3:
            raise OSError("no reader")
        return {2: "read from the image", 4: ""}.get(page)

    long = "text " * 20
    assert files.routed([(1, long), (2, "few"), (3, "kept"), (4, " few "), (5, None)], scan) == [(1, long), (2, "read from the image"), (3, "kept"), (4, " few "), (5, "")]
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.txt").write_text("x")
    found = files.resolve(spark, "a.txt", (str(tmp_path), f"{tmp_path}/up"))
    assert found == f"file:{tmp_path}/up/a.txt" and files.resolve(spark, found) == found
    assert files.resolve(spark, f"{tmp_path}/none") == f"file:{tmp_path}/none"
    name = one(spark, files.storage_name(F.col("n")), n="../x\\y/report 1.pdf")
    assert re.fullmatch(r"[0-9a-f-]{36}-report 1\.pdf", name)


def test_vectors_of_many_calls_keep_their_order(spark):
    df = spark.createDataFrame([(k, f"w{k}") for k in range(50)], "k int, t string")

    def slow(texts):
        assert len(texts) <= 3
        time.sleep(random.random() / 50)
        return embedding.hashed_model(texts)

    a, b = (embedding.embed(df, F.col("t"), *x).orderBy("k").collect() for x in ((), (slow, 5, 3)))
    assert a == b


def test_vectors(spark):
    pick = random.Random(0)
    vectors = [(k, [pick.gauss(0, 1) + (k % 4) * (j == k % 4) * 4 for j in range(8)]) for k in range(200)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    centres = vectorsearch.fit_lists(df, lists=4)
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = vectorsearch.ivf_top_k(vectorsearch.nearest_lists(df, centres), asked, centres, k=5, probes=3).collect()
    m = np.array([v for _, v in vectors])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hits = sum(r.vec_id in np.argsort(-(m @ m[r.query_id]))[:5] for r in got)
    assert hits >= 0.9 * 5 * 10
    assert vectorsearch.top_k(df, vectors[3][1], 1).first().vec_id == 3
    e = embedding.embed(spark.createDataFrame([("a b",), (None,)], "t string"), F.col("t")).collect()
    assert all(len(r.embedding) == embedding.DIMENSIONS for r in e)


def test_cleaning_of_all_documents_against_python(spark, tmp_path):
    import re

    from cairn.queries import QUERIES

    def dehyphenated(t):
        t = re.sub(r"(\b[A-Za-z]+)-\s*\n\s*([a-z]+[A-Za-z]*\b)", r"\1\2", t)
        return re.sub(r"(\b[A-Za-z0-9]+)-\s*\n\s*([A-Za-z0-9]+\b)", r"\1-\2", t)

    def cleaned(t):
        t = re.sub(r"\r\n?", "\n", t or "")
        t = re.sub("(?m)^\\s*[\ufffd\u2022\u2023\u25e6\u2043\u2219\u25aa\u25ab\u00b7\u25ba\u203a]\\s*", "- ", t)
        return re.sub(r"[ \t]{2,}", " ", dehyphenated(t)).strip()

    texts = ["Die Lektion über Größe. Ende", "éa-\nb nation-\u00a0\nal", "ab-\u2003\ncé x", "la acción, tion\u2019s  motion.  fin\u00a0", "\u2022 plain station", "ñ-\nx ab-\nC9", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {q: {r.doc_id: r.text for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("dehyphenate", "text_clean")}
    split = lambda t: t.replace("tion", "ti-\non")
    assert got["dehyphenate"] == {k: None if t is None else dehyphenated(split(t)) for k, t in enumerate(texts)}
    assert got["text_clean"] == {k: cleaned(None if t is None else "\u2022 " + split(t).replace(". ", ".\r\n")) for k, t in enumerate(texts)}


def test_text_measures_against_patterns(spark):
    """Trims and counts are those of the plain patterns, whatever the white space and whatever stands around."""
    blanks = [chr(k) for k in range(0x3100) if chr(k).isspace() and not 0x1C <= k <= 0x1F]
    assert sorted(blanks) == sorted(T.BLANKS)
    pick = random.Random(5)
    pieces = [*T.BLANKS, "\x1c", "\u200b", "\ufeff", "\ufffd", "a", "\u00e9", "Z9", "-", ".", "[h] ", "word", "\U0001d54f", "日本", "é", "\n"]
    texts = ["", " ", "\n\n", "a-", "[head] a-", "[head] -", "[a-", "a-\n", None] + ["".join(pick.choices(pieces, k=pick.randint(1, 60))) for _ in range(400)]
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        T.strip(c).alias("strip"), F.regexp_replace(c, r"(?U)^\s+|\s+$", "").alias("strip_"),
        T.token_count(c).alias("tokens"), F.regexp_count(c, F.lit(r"(?U)\S+")).alias("tokens_"),
        T.is_broken(c).alias("broken"), F.regexp_like(F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), r"^\[[^\]\n]{1,120}\]\s+", ""), F.lit(r"[A-Za-z0-9]-$")).alias("broken_"),
        T.is_noise(c).alias("noise"), ((F.char_length(c) >= 40) & ((F.regexp_count(c, F.lit(r"\x{FFFD}")) >= 3) | (F.regexp_count(c, F.lit(r"[\p{L}\p{N}]")) / F.char_length(c) < 0.35)
            | F.coalesce((F.regexp_count(c, F.lit(r"(?U)\S+")) >= 20) & (F.regexp_count(c, F.lit(r"(?U)(?<!\S)\p{L}(?!\S)")) / F.regexp_count(c, F.lit(r"(?U)\S+")) > 0.4), F.lit(False)))).alias("noise_"),
    )
    for r in rows.collect():
        assert (r.strip, r.tokens, r.broken, r.noise) == (r.strip_, r.tokens_, r.broken_, r.noise_), r
