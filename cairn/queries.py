"""Registered queries on the supplied tables, each with its SQL where SQL can say it.

Stand-ins: orders and lineitem for documents and chunks, events for the job log
and telemetry, conversations for structured text, embeddings for chunk vectors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import lifecycle, structure, telemetry, validation, vectorsearch
from cairn.operators.chunking import chunk_sections, numbered
from cairn.plans import ingestion, tenancy
from cairn.schemas import document_expectations, new_users, orphans, registration_errors
from cairn.sources import files
from cairn.streaming.jobs import rate_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- document text ------------------------------------------------------------

WS = r"[\s\x{85}\x{a0}]"
STRIP_SQL = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def sentence_rows(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", "lang", F.posexplode(T.sentences(T.sanitize(F.col("text")))).alias("chunk_index", "content"))


SENTENCES = r"""s AS (SELECT doc_id, lang, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS content FROM
 (SELECT doc_id, lang, string_split(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS x FROM documents)),
 w AS (SELECT doc_id, lang, pos, content, list_filter(regexp_split_to_array(content, '\s+'), lambda t: t <> '') AS words,
  length(regexp_replace(content, '[^\p{L}\p{N}]', '', 'g')) AS letters, length(content) AS n FROM s WHERE content <> ''),
 v AS (SELECT *, n < 15 OR len(words) < 4 AS trivial,
  n >= 40 AND (length(content) - length(replace(content, chr(65533), '')) >= 3 OR letters / n < 0.35 OR (len(words) >= 20 AND len(list_filter(words, lambda t: length(t) = 1 AND regexp_matches(t, '^\p{L}$'))) / len(words) > 0.40)) AS noise,
  regexp_matches(regexp_replace(content, '^\[[^\]\n]{1,120}\]\s+', ''), '[A-Za-z0-9]-$') AS broken,
  sha256(regexp_replace(lower(content), '\s+', ' ', 'g')) AS key FROM w)"""


@query(f"""WITH {SENTENCES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS r FROM v WHERE NOT trivial AND NOT noise AND NOT broken AND len(words) <= 500)
 SELECT lang, count(*) AS n_sentences, count(DISTINCT doc_id) AS n_docs, CAST(sum(n) AS BIGINT) AS n_chars FROM k WHERE r = 1 GROUP BY lang""")
def sentence_corpus(spark, d):
    """Flagship: sentences that pass the filters, without repeats in a document, by language."""
    rows = sentence_rows(spark, d).withColumnRenamed("doc_id", "doc")
    ok = validation.judged(rows).where("verdict = 'ok'")
    return ok.groupBy("lang").agg(F.count("*").alias("n_sentences"), F.countDistinct("doc").alias("n_docs"), F.sum("n_chars").alias("n_chars"))


@query(f"WITH {SENTENCES} SELECT doc_id, content, count(*) AS n FROM w GROUP BY doc_id, content")
def sentences(spark, d):
    return sentence_rows(spark, d).groupBy("doc_id", "content").agg(F.count("*").alias("n"))


@query(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n, CAST(count_if(trivial) AS BIGINT) AS n_trivial, CAST(count_if(noise) AS BIGINT) AS n_noise, CAST(count_if(broken) AS BIGINT) AS n_broken FROM v GROUP BY doc_id")
def trivial_noise_boundary(spark, d):
    c = F.col("content")
    rows = sentence_rows(spark, d)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(T.is_trivial(c, T.token_count(c))).alias("n_trivial"), F.count_if(T.is_noise(c)).alias("n_noise"), F.count_if(T.is_broken(c)).alias("n_broken"))


@query(f"""WITH {SENTENCES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS r FROM v WHERE NOT trivial AND NOT noise AND NOT broken AND len(words) <= 500)
 SELECT doc_id, content, CAST(pos AS INTEGER) AS chunk_index FROM k WHERE r = 1""")
def exact_dedup(spark, d):
    ok = validation.judged(sentence_rows(spark, d).withColumnRenamed("doc_id", "doc")).where("verdict = 'ok'")
    return ok.select(F.col("doc").alias("doc_id"), F.col("clean").alias("content"), "chunk_index")


@query(f"""WITH {SENTENCES}, g AS (SELECT *, CASE WHEN trivial THEN 'empty' WHEN noise THEN 'noise' WHEN broken THEN 'broken' WHEN len(words) > 500 THEN 'long' ELSE 'ok' END AS q FROM v),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key, q ORDER BY pos) AS r FROM g)
 SELECT doc_id AS doc, count(*) AS n_input, CAST(count_if(q = 'ok' AND r = 1) AS BIGINT) AS n_valid, CAST(count_if(q = 'empty') AS BIGINT) AS n_empty, CAST(count_if(q = 'ok' AND r > 1) AS BIGINT) AS n_duplicates,
 CAST(count_if(q IN ('noise', 'broken', 'long')) AS BIGINT) AS n_malformed, CAST(count_if(q = 'long') AS BIGINT) AS n_over_limit, CAST(0 AS BIGINT) AS n_repaired FROM k GROUP BY doc_id""")
def validation_summary(spark, d):
    return validation.summary(validation.judged(sentence_rows(spark, d).withColumnRenamed("doc_id", "doc")))


@query(f"""WITH {SENTENCES}, k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS r FROM v WHERE NOT trivial AND NOT noise AND NOT broken AND len(words) <= 500)
 SELECT doc_id AS doc, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS new_index, CAST(pos AS INTEGER) AS chunk_index FROM k WHERE r = 1""")
def reindex_dense(spark, d):
    return validation.reindexed(validation.judged(sentence_rows(spark, d).withColumnRenamed("doc_id", "doc"))).select("doc", "new_index", "chunk_index")


@query()
def near_dedup(spark, d):
    """Sequence-matcher duplicates among a document's lines."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return validation.summary(validation.near_duplicates(validation.judged(rows)))


BROKEN = "chr(8226) || ' ' || replace(replace(text, 'tion', 'ti-' || chr(10) || 'on'), '. ', '.' || chr(13) || chr(10))"
#: White space and word characters beyond ASCII, spelled out: this SQL engine's \s and \b are ASCII.
BLANK = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORDLY = "|".join(rf"[^\x00-\x7f\P{{{k}}}]" for k in ("L", "M", "Nd", "Nl", "Pc"))


def broken_text():
    return F.concat(F.lit("• "), F.replace(F.replace("text", F.lit("tion"), F.lit("ti-\non")), F.lit(". "), F.lit(".\r\n")))


# A word character beyond ASCII is fenced by underscores for the while, so that \\b sees a word there.
FENCED = rf"""regexp_replace({{}}, '({WORDLY})', '_' || chr(57344) || '\1' || chr(57344) || '_', 'g')"""
JOINED = rf"""regexp_replace(regexp_replace({{}}, '(\b[A-Za-z]+)-{BLANK}*\n{BLANK}*([a-z]+[A-Za-z]*\b)', '\1\2', 'g'), '(\b[A-Za-z0-9]+)-{BLANK}*\n{BLANK}*([A-Za-z0-9]+\b)', '\1-\2', 'g')"""


def dehyphenated_sql(text: str) -> str:
    joined = JOINED.replace("{}", FENCED.replace("{}", text))
    return f"replace(replace({joined}, '_' || chr(57344), ''), chr(57344) || '_', '')"


@query("SELECT doc_id, " + dehyphenated_sql("replace(text, 'tion', 'ti-' || chr(10) || 'on')") + " AS text FROM documents")
def dehyphenate(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dehyphenate(F.replace("text", F.lit("tion"), F.lit("ti-\non"))).alias("text"))


UNBULLETED = rf"""regexp_replace(regexp_replace({BROKEN}, '\r\n?', chr(10), 'g'), '(?m)^{BLANK}*[\x{{FFFD}}\x{{2022}}\x{{2023}}\x{{25E6}}\x{{2043}}\x{{2219}}\x{{25AA}}\x{{25AB}}\x{{00B7}}\x{{25BA}}\x{{203A}}]{BLANK}*', '- ', 'g')"""
CLEANED = rf"regexp_replace(regexp_replace({dehyphenated_sql(UNBULLETED)}, '[ \t]{{2,}}', ' ', 'g'), '^{BLANK}+|{BLANK}+$', '', 'g')"


@query(f"SELECT doc_id, {CLEANED} AS text FROM documents")
def text_clean(spark, d):
    return table(spark, d, "documents").select("doc_id", T.clean(broken_text()).alias("text"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, ' de ', chr(160) || 'de '), '. ', '.' || repeat(chr(10), 4)), '[\x00-\x08\x0b-\x1f\x7f-\x{a0}\x{ad}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents""")
def sanitize(spark, d):
    text = F.replace(F.replace("text", F.lit(" de "), F.lit(chr(160) + "de ")), F.lit(". "), F.lit(".\n\n\n\n"))
    return table(spark, d, "documents").select("doc_id", T.sanitize(text).alias("text"))


@query()
def page_stitch(spark, d):
    """Turns as pages, a hyphen put at each page's end."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn").alias("page"), F.concat(F.regexp_replace("text", r"[.!?\s]+$", ""), F.lit("-")).alias("text")))).alias("pages"))
    return turns.select("conv_id", F.inline(T.stitch("pages")))


# --- structure ----------------------------------------------------------------


def pages(spark, d):
    """Each turn as a page: its role as a heading, its sentences by turns as prose and list lines."""
    turns = table(spark, d, "conversations")
    body = F.replace(F.replace("text", F.lit(". "), F.lit(".\n- ")), F.lit(", "), F.lit(",\n"))
    return turns.select(F.col("conv_id").alias("doc"), F.col("turn").cast("int").alias("page"), F.concat(F.upper("role"), F.lit("\n\n"), body).alias("text"))


LINES = r"""p AS (SELECT DISTINCT conv_id AS doc, turn AS page, upper(role) || chr(10) || chr(10) || replace(replace(text, '. ', '.' || chr(10) || '- '), ', ', ',' || chr(10)) AS text FROM conversations),
 a AS (SELECT doc, page, generate_subscripts(x, 1) AS para, unnest(x) AS body FROM (SELECT doc, page, string_split_regex(text, '\n\s*\n') AS x FROM p)),
 b AS (SELECT doc, page, para, generate_subscripts(x, 1) AS line_no, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc, page, para, string_split(body, chr(10)) AS x FROM a)),
 l AS (SELECT *, CASE WHEN length(line) > 85 THEN 0 WHEN regexp_matches(line, '^(#{1,6})\s+(.+)$') THEN length(regexp_extract(line, '^(#{1,6})\s+(.+)$', 1))
  WHEN regexp_matches(line, '[.,;:?!]$') OR regexp_matches(line, '[|@]|https?://') THEN 0
  WHEN regexp_matches(line, '(?i)^(?:(?:SECTION|CHAPTER|PART)\s+\d+|\d+(?:\.\d+)*)\s+([A-Z0-9].{2,80})$') THEN 1
  WHEN regexp_matches(line, '^[A-Z0-9\s&/\-,:|]{3,65}$') AND length(regexp_replace(line, '[^A-Z]', '', 'g')) >= 3 THEN 1 ELSE 0 END AS level,
  regexp_matches(line, '^[-*\x{2022}\x{25AA}\x{25AB}\x{25BA}\x{203A}]\s+(.+)$') OR regexp_matches(line, '^(\d+|[a-zA-Z])[.)]\s+(.+)$') AS is_list FROM b WHERE line <> ''),
 c AS (SELECT *, CAST(sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page, para, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM l),
 e AS (SELECT *, bool_or(is_list) OVER (PARTITION BY doc, page, para, section ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS in_list FROM c WHERE level = 0),
 k AS (SELECT doc, section, page, para, in_list, substr(string_agg(CASE WHEN is_list THEN chr(10) ELSE ' ' END || line, '' ORDER BY line_no), 2) AS content FROM e GROUP BY ALL)"""


@query(f"WITH {LINES} SELECT doc, page, line, CAST(level AS INTEGER) AS level, count(*) AS n FROM l WHERE level > 0 GROUP BY ALL")
def heading_lines(spark, d):
    rows = structure.lines(pages(spark, d).distinct()).where("level > 0")
    return rows.groupBy("doc", "page", "line", "level").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc, page, count(*) AS n, CAST(count_if(is_list) AS BIGINT) AS n_list FROM l GROUP BY ALL")
def list_lines(spark, d):
    return structure.lines(pages(spark, d).distinct()).groupBy("doc", "page").agg(F.count("*").alias("n"), F.count_if("is_list").alias("n_list"))


@query(f"WITH {LINES} SELECT doc, section, page, CAST(para - 1 AS INTEGER) AS para, CASE WHEN in_list THEN 'list_item' ELSE 'paragraph' END AS block_type, content FROM k")
def blocks(spark, d):
    return structure.blocks(pages(spark, d).distinct())


@query(f"""WITH {LINES}, h AS (SELECT doc, section, arg_min(line, (page, para, line_no)) AS heading, max(level) AS level, min(page) AS page_start FROM c GROUP BY ALL),
 z AS (SELECT doc, section, max(page) AS last FROM (SELECT doc, page, para, max(section) AS section FROM c GROUP BY ALL) GROUP BY ALL),
 t AS (SELECT doc, section, string_agg(content, chr(10) || chr(10) ORDER BY page, para, in_list) AS body, count(*) AS n FROM k GROUP BY ALL)
 SELECT doc, section, heading, CAST(h.level AS INTEGER) AS heading_level, page_start, coalesce(z.last, page_start) AS page_end, CAST(coalesce(t.n, 0) AS INTEGER) AS n_blocks,
 CASE WHEN heading <> 'Preamble' THEN heading || coalesce(chr(10) || chr(10) || body, '') ELSE body END AS full_text
 FROM (SELECT doc, section, CASE WHEN section = 0 THEN 'Preamble' ELSE heading END AS heading, level, page_start FROM h) h LEFT JOIN z USING (doc, section) LEFT JOIN t USING (doc, section) WHERE heading <> 'Preamble' OR t.n > 0""")
def sections(spark, d):
    rows = structure.sections(pages(spark, d).distinct())
    return rows.select("doc", "section", "heading", "heading_level", "page_start", "page_end", F.size("blocks").alias("n_blocks"), "full_text")


@query()
def chunks_full(spark, d):
    """Section-aware chunks of at most 40 white-space tokens, with sentence overlap of 8."""
    return numbered(chunk_sections(structure.sections(pages(spark, d).distinct()), 40, 8))


# --- relational surface ---------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 100")
def doc_list_recent(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").orderBy(F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")).limit(100)


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 42")
def doc_point_lookup(spark, d):
    return table(spark, d, "documents").where("doc_id = 42").select("doc_id", "lang", "source", "n_chars")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 7")
def child_rows_ordered(spark, d):
    return table(spark, d, "lineitem").where("l_orderkey = 7").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").orderBy("l_linenumber")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 10")
def tenant_documents(spark, d):
    return tenancy.tenant_rows(table(spark, d, "orders"), "o_custkey", 10).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 10)")
def tenant_chunks_semijoin(spark, d):
    rows = tenancy.tenant_children(table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey", "o_custkey", 10)
    return rows.select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def cascade_antijoin(spark, d):
    gone = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return lifecycle.without_children(table(spark, d, "lineitem"), gone, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS orphans FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)")
def fk_orphans(spark, d):
    customers = table(spark, d, "customer").where("c_custkey % 7 <> 0")
    return orphans(table(spark, d, "orders"), customers, "o_custkey", "c_custkey").agg(F.count("*").alias("orphans"))


@query("SELECT o_orderkey, 'uploads/' || o_orderkey AS storage_path, 1000 + row_number() OVER (ORDER BY substr(md5('uploads/' || o_orderkey), 1, 3), 'uploads/' || o_orderkey) AS id, 'pending' AS status FROM orders")
def stage_documents(spark, d):
    """Orders as uploads that get their ids."""
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("uploads/"), F.col("o_orderkey").cast("string")).alias("storage_path"))
    return lifecycle.stage(rows, 1000)


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN length(substr(c_mktsegment, 1, 1 + c_custkey % 9)) < 3 THEN 'username' END, CASE WHEN length(substr(c_name, 1, 5 + c_custkey % 6)) < 8 THEN 'password' END,
 CASE WHEN c_custkey % 3 = 0 THEN 'email' END, CASE WHEN length(repeat('5', CAST(15 + c_nationkey AS INTEGER))) > 20 THEN 'contact_no' END, CASE WHEN TRY_CAST('1990-02-' || lpad(CAST(1 + c_custkey % 31 AS VARCHAR), 2, '0') AS DATE) IS NULL THEN 'dob' END) AS errors FROM customer""")
def registration_checks(spark, d):
    """Customers as registrations, some with a short name or password, no mail address, a long number or no such date."""
    key = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_custkey", F.col("c_name").alias("name"), F.substr("c_mktsegment", F.lit(1), 1 + key % 9).alias("username"), F.substr("c_name", F.lit(1), 5 + key % 6).alias("password"),
        F.concat("c_name", F.when(key % 3 == 0, F.lit("")).otherwise(F.lit("@example.org"))).alias("email"),
        F.repeat(F.lit("5"), 15 + F.col("c_nationkey")).alias("contact_no"), F.concat(F.lit("1990-02-"), F.lpad((1 + key % 31).cast("string"), 2, "0")).alias("dob"),
    )  # fmt: skip
    return rows.select("c_custkey", F.array_join(registration_errors(rows), ",").alias("errors"))


@query("""SELECT doc_id, n_chars - 100 >= 0 AS size_ok, doc_id % 7 < 6 AS file_type_ok, doc_id % 5 < 4 AS status_ok FROM documents""")
def document_checks(spark, d):
    """Documents as upload rows, some below zero in size or outside the enumerations."""
    kinds, states = (F.array(*[F.lit(x) for x in values]) for values in (("JPG", "JPEG", "PNG", "PDF", "DOCX", "TXT", "EXE"), ("pending", "processing", "completed", "failed", None)))
    pick = lambda of, n: F.get(of, (F.col("doc_id") % n).cast("int"))  # noqa: E731
    rows = table(spark, d, "documents").select("doc_id", (F.col("n_chars") - 100).alias("size_bytes"), pick(kinds, 7).alias("file_type"), pick(states, 5).alias("status"))
    return rows.select("doc_id", *[c.alias(k) for k, c in document_expectations().items()])


@query("SELECT c_custkey, c_name AS username FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0")
def free_users(spark, d):
    """Customers as candidates; of a third the name is taken, of a fifth the address."""
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("username"), F.concat("c_name", F.lit("@example.org")).alias("email"))
    key = F.col("c_custkey")
    users = rows.where((key % 3 == 0) | (key % 5 == 0)).select(F.when(key % 3 == 0, F.col("username")).alias("username"), F.when(key % 5 == 0, F.col("email")).alias("email"))
    return new_users(rows, users).select("c_custkey", "username")


@query("SELECT doc_id, CAST(to_json({'doc_id': doc_id, 'lang': nullif(lang, 'fr'), 'source': source, 'n_chars': n_chars}) AS VARCHAR) AS body FROM documents")
def document_json(spark, d):
    """Rows as a service would return them, null fields included."""
    body = F.struct("doc_id", F.nullif(F.col("lang"), F.lit("fr")).alias("lang"), "source", "n_chars")
    return table(spark, d, "documents").select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))


@query(r"""SELECT doc_id, kind AS file_type, coalesce(kind = CASE doc_id % 3 WHEN 0 THEN 'TXT' ELSE 'PDF' END, FALSE) AS accepted FROM (SELECT doc_id, CASE WHEN starts_with(x, '%PDF') THEN 'PDF'
 WHEN x = '' OR contains(x, chr(0)) OR length(regexp_replace(x, '[^--]', '', 'g')) >= 0.01 * strlen(x) THEN NULL ELSE 'TXT' END AS kind
 FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '%PDF-1.7 ' || text WHEN 1 THEN '' WHEN 2 THEN replace(text, ' ', chr(1)) ELSE text END AS x FROM documents))""")
def upload_types(spark, d):
    """Texts as uploads: behind a PDF mark, emptied, with control bytes for blanks, or as they are."""
    k = F.col("doc_id") % 5
    x = F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), F.col("text"))).when(k == 1, F.lit("")).when(k == 2, F.replace("text", F.lit(" "), F.lit("\x01"))).otherwise(F.col("text"))
    name = F.when(F.col("doc_id") % 3 == 0, F.lit("a.txt")).otherwise(F.lit("b.pdf"))
    rows = table(spark, d, "documents").select("doc_id", name.alias("name"), files.sniff(F.encode(x, "UTF-8")).alias("file_type"))
    return rows.select("doc_id", "file_type", files.accepts(F.col("file_type"), F.col("name")).alias("accepted"))


@query("""SELECT doc_id, CASE WHEN message IS NULL THEN 'completed' ELSE 'failed' END AS status, message FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN substr(text, 1, 1000)
 WHEN doc_id % 4 = 0 THEN 'No extractable text found in document' WHEN doc_id % 3 = 0 THEN 'No valid chunks remained after validation' END AS message FROM documents)""")
def run_outcomes(spark, d):
    """Statuses and messages of runs; each fifth fails with its text as the exception's."""
    key = F.col("doc_id")
    status, message = lifecycle.outcome(key % 4, key % 3, F.when(key % 5 == 0, F.col("text")))
    return table(spark, d, "documents").select("doc_id", status.alias("status"), message.alias("message"))


# --- telemetry ------------------------------------------------------------------

STATUS = {"purchase": "completed", "click": "completed", "error": "failed", "signup": "processing"}
STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'processing' ELSE 'pending' END"
K_SQL = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
RUNS = f"r AS (SELECT event_id AS id, user_id, ts, value AS v, {K_SQL} AS k, {STATUS_SQL} AS status, event_type = 'purchase' AS run FROM events)"


def jobs(spark, d):
    """Events as documents; purchases are runs with telemetry, clicks older runs without."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    status = F.lit("pending")
    for kind, name in STATUS.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    run = F.to_json(F.struct(
        F.col("value").alias("worker_pipeline_duration_s"), (F.col("value") + F.col("k")).alias("upload_to_completion_duration_s"), F.col("k").alias("queue_wait_duration_s"), F.col("k").cast("int").alias("chunks_count"),
        F.struct((F.col("value") / 2).alias("embedding_generation_s"), (F.col("value") / 4).alias("database_persistence_s"), (F.col("value") / 8).alias("text_extraction_s")).alias("stage_timings"),
    ))  # fmt: skip
    metrics = F.parse_json(F.when(F.col("event_type") == "purchase", run).otherwise(F.lit("{}")))
    return e.select(F.col("event_id").alias("id"), "user_id", "ts", status.alias("status"), metrics.alias("metrics"))


@query(f"WITH {RUNS} SELECT status, count(*) AS n FROM r GROUP BY status")
def status_counts(spark, d):
    return jobs(spark, d).groupBy("status").agg(F.count("*").alias("n"))


def med(x):
    return f"CASE WHEN count({x}) % 2 = 1 THEN median({x}) ELSE round(median({x}), 4) END"


@query(f"""WITH {RUNS}, m AS (SELECT *, CASE WHEN run THEN v END AS w, CASE WHEN run THEN v + k END AS e, CASE WHEN run THEN k END AS q FROM r)
 SELECT count(*) AS total, CAST(count_if(status = 'completed') AS BIGINT) AS completed, CAST(count_if(status = 'failed') AS BIGINT) AS failed, CAST(count_if(status IN ('pending', 'processing')) AS BIGINT) AS pending, CAST(count_if(run) AS BIGINT) AS runs_with_metrics, count_if(run) > 0 AS sufficient_data,
 CAST(sum(CASE WHEN run THEN k ELSE 0 END) AS BIGINT) AS total_chunks, round(avg(w), 4) AS avg_worker_s, {med('w')} AS median_worker_s, min(w) AS min_worker_s, max(w) AS max_worker_s,
 round(avg(e), 4) AS avg_e2e_s, {med('e')} AS median_e2e_s, min(e) AS min_e2e_s, max(e) AS max_e2e_s, round(avg(q), 4) AS avg_queue_s, {med('q')} AS median_queue_s,
 round(avg(w / 2), 4) AS avg_embedding_s, round(avg(w / 4), 4) AS avg_persistence_s, round(avg(w / 8), 4) AS avg_extraction_s FROM m""")
def metrics_summary(spark, d):
    return telemetry.summary(jobs(spark, d))


@query(f"WITH {RUNS} SELECT id, run AS has_telemetry, CASE WHEN run THEN v END AS worker_s FROM r")
def metrics_presence_filter(spark, d):
    return jobs(spark, d).select("id", telemetry.has_telemetry().alias("has_telemetry"), telemetry.number("$.worker_pipeline_duration_s").alias("worker_s"))


@query(f"WITH {RUNS} SELECT id, status, CASE WHEN run THEN nullif(CAST(k AS BIGINT), 0) END AS chunks_count, CASE WHEN run THEN k END AS queue_wait_s, CASE WHEN run THEN v END AS worker_s, CASE WHEN run THEN v + k END AS e2e_s FROM r")
def metrics_history(spark, d):
    return telemetry.history(jobs(spark, d))


@query("""WITH s AS (SELECT l_orderkey, sum(l_quantity) AS a, sum(l_tax) AS b, sum(l_discount) AS c FROM lineitem GROUP BY 1)
 SELECT l_orderkey, round(100 * a / t, 1) AS quantity_pct, round(100 * b / t, 1) AS tax_pct, round(100 * c / t, 1) AS discount_pct FROM (SELECT *, CASE WHEN a + b + c = 0 THEN 1.0 ELSE a + b + c END AS t FROM s)""")
def stage_share_pct(spark, d):
    """Sums are free of the rows' order, else shares that end in half a place round either way; null where a sum is null."""
    sums = {"quantity": "l_quantity", "tax": "l_tax", "discount": "l_discount"}
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[telemetry.steady_sum(F.col(c)).alias(k) for k, c in sums.items()])
    known = F.expr(" AND ".join(f"{k} IS NOT NULL" for k in sums))
    shares = telemetry.stage_shares({k: F.col(k) for k in sums})
    return s.select("l_orderkey", *[F.when(known, x).alias(f"{k}_pct") for k, x in zip(sums, shares, strict=True)])


@query(f"WITH {RUNS} SELECT id, round(1 - k / nullif(v + k, 0), 6) AS efficiency FROM r WHERE run")
def queue_efficiency(spark, d):
    n = telemetry.number
    rows = jobs(spark, d).where(telemetry.has_telemetry())
    return rows.select("id", F.round(telemetry.queue_efficiency(n("$.queue_wait_duration_s"), n("$.upload_to_completion_duration_s")), 6).alias("efficiency"))


@query(f"WITH {RUNS} SELECT id, ts FROM r WHERE status = 'processing' AND ts < {NOW} - INTERVAL 10 MINUTES")
def stale_jobs_sweep(spark, d):
    rows = jobs(spark, d).withColumnRenamed("ts", "processing_started_at")
    return lifecycle.stale(rows, F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("id", F.col("processing_started_at").alias("ts"))


@query(f"WITH {RUNS} SELECT user_id, id, status, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS x FROM r) WHERE x = 1")
def job_latest_status(spark, d):
    return lifecycle.latest_status(jobs(spark, d).select("user_id", "id", "status", "ts"), "user_id", ["ts", "id"])


@query(f"WITH {RUNS} SELECT id, CASE WHEN old THEN 'failed' ELSE status END AS status, CASE WHEN old THEN 'processing timed out' END AS error_message FROM (SELECT *, status = 'processing' AND ts < {NOW} - INTERVAL 10 MINUTES AS old FROM r)")
def swept_jobs(spark, d):
    rows = jobs(spark, d).withColumnRenamed("ts", "processing_started_at").withColumn("error_message", F.lit(None).cast("string"))
    return lifecycle.sweep(rows, F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("id", "status", "error_message")


@query(f"WITH {RUNS} SELECT id, CASE WHEN user_id % 2 = 0 THEN 'processing' ELSE status END AS status, CASE WHEN user_id % 2 = 0 THEN {NOW} ELSE ts END AS processing_started_at FROM r")
def begun_jobs(spark, d):
    """The jobs of every other user as one batch that begins."""
    rows = jobs(spark, d).withColumnRenamed("ts", "processing_started_at")
    batch = rows.where("user_id % 2 = 0").select(F.col("id").alias("document_id"))
    return ingestion.to_processing(rows, batch, F.expr(NOW.replace("TIMESTAMP", "TIMESTAMP_NTZ"))).select("id", "status", "processing_started_at")


@query("SELECT user_id AS client, time_bucket(INTERVAL 15 MINUTES, ts) AS start, count(*) AS n, count(*) > 1 AS limited FROM events GROUP BY ALL")
def rate_limits(spark, d):
    requests = table(spark, d, "events").select("ts", F.col("user_id").alias("client"))
    return rate_windows(requests, 15, 1)


@query(f"WITH {RUNS} SELECT id, round(v, 4) AS extraction_s, round(v / 4, 4) AS chunking_s, k AS embedding_s, CAST(NULL AS DOUBLE) AS persistence_s, round(k * 0.25 + v / 2000 * 0.5, 8) AS eta_s FROM r")
def timings_and_eta(spark, d):
    """Stage timings of a run, one of them not measured, and the time that the next would take."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("value").alias("v"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    timings = telemetry.stage_timings({"text_extraction_s": F.col("v"), "section_chunking_s": F.col("v") / 4, "embedding_generation_s": F.col("k")})
    names = {"extraction_s": "text_extraction_s", "chunking_s": "section_chunking_s", "embedding_s": "embedding_generation_s", "persistence_s": "database_persistence_s"}
    eta = F.round(telemetry.eta_s(F.col("k"), F.lit(0.25), F.col("v"), F.lit(0.5)), 8)
    return rows.withColumn("t", timings).select("id", *[F.col(f"t.{c}").alias(k) for k, c in names.items()], eta.alias("eta_s"))


DEQUEUED = "(epoch_ms(ts) + CAST(1000 * k AS BIGINT))"


@query(f"""WITH {RUNS} SELECT id, round((d - u) / 1000, 4) AS queue_wait_duration_s, round((e - d) / 1000, 4) AS worker_pipeline_duration_s, round((e - u) / 1000, 4) AS upload_to_completion_duration_s, printf('%.1f', round(id / 1024, 1)) AS size_kb, CASE WHEN run THEN CAST(CAST(k AS INTEGER) AS VARCHAR) ELSE '--' END AS chunks_shown
 FROM (SELECT *, epoch_ms(ts) AS u, {DEQUEUED} AS d, {DEQUEUED} + CAST(round(1000 * v) AS BIGINT) AS e FROM r)""")
def job_durations(spark, d):
    """Durations from the three instants of a run, and the columns that a list shows."""
    rows = jobs(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("id"), "value", F.get_json_object("props", "$.k").cast("double").alias("k")), "id")
    u = F.unix_millis(F.col("ts").cast("timestamp"))
    begun = u + (1000 * F.col("k")).cast("long")
    times = telemetry.durations(u, begun, begun + F.round(1000 * F.col("value")).cast("long"))
    shown = telemetry.shown(F.when(F.col("status") == "completed", telemetry.number("$.chunks_count").cast("int")))
    return rows.select("id", *[c.alias(k) for k, c in times.items()], telemetry.size_kb(F.col("id")).alias("size_kb"), shown.alias("chunks_shown"))


@query(f"WITH {RUNS} SELECT status, 1000 * sum(v) / nullif(sum(k), 0) AS ms_per_chunk, CAST(max(k) AS BIGINT) AS max_tokens FROM r GROUP BY status")
def embedding_rate(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double")).join(jobs(spark, d).select(F.col("id").alias("event_id"), "status"), "event_id")
    return rows.groupBy("status").agg(telemetry.embed_ms_per_chunk(F.col("value"), F.col("k")).alias("ms_per_chunk"), F.max("k").cast("long").alias("max_tokens"))


@query(f"WITH {RUNS} SELECT status, CAST(sum(length(d.text)) AS BIGINT) AS total_characters FROM r JOIN documents d ON d.doc_id = r.id GROUP BY status")
def extracted_characters(spark, d):
    """Characters of the documents behind the jobs, by status."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.char_length("text").alias("n"))
    return jobs(spark, d).select("id", "status").join(docs, "id").groupBy("status").agg(F.sum("n").alias("total_characters"))


# --- vectors --------------------------------------------------------------------

AXIS = [1.0 if k % 2 else 0.5 for k in range(64)]
AXIS_SQL = "list_transform(range(64), lambda k: CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END)"


@query(f"SELECT vec_id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {AXIS_SQL}), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {AXIS_SQL}), vec_id LIMIT 10")
def vector_topk(spark, d):
    return vectorsearch.top_k(table(spark, d, "embeddings"), AXIS, 10).withColumn("distance", F.round("distance", 6))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimensions FROM embeddings")
def vector_dimensions(spark, d):
    """Every vector passes the check of its length, else the query fails."""
    return table(spark, d, "embeddings").select("vec_id", F.size(T.require_dimension(F.col("embedding"), 64)).alias("dimensions"))


@query()
def ivf_topk(spark, d):
    """Every 20th vector against all, through inverted lists."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    centres = vectorsearch.fit_lists(vectors, lists=16)
    index = vectorsearch.nearest_lists(vectors, centres)
    asked = vectors.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    return vectorsearch.ivf_top_k(index, asked, centres, k=5, probes=12)


@query(f"""WITH a AS (SELECT vec_id AS id, row_number() OVER (ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], {AXIS_SQL}), vec_id) AS rank FROM embeddings QUALIFY rank <= 50),
 b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50)
 SELECT id, round(coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0), 9) AS score FROM a FULL JOIN b USING (id) ORDER BY coalesce(1 / (60 + a.rank), 0) + coalesce(1 / (60 + b.rank), 0) DESC, id LIMIT 10""")
def rrf_hybrid(spark, d):
    """Extension: a dense and a lexical ranking fused."""
    from pyspark.sql import Window as W

    dense = vectorsearch.top_k(table(spark, d, "embeddings"), AXIS, 50).withColumn("rank", F.row_number().over(W.orderBy("distance", "vec_id"))).withColumnRenamed("vec_id", "id")
    longest = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(50)
    sparse = longest.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_chars"), "doc_id"))).withColumnRenamed("doc_id", "id")
    return vectorsearch.fused(dense, sparse, 10).withColumn("score", F.round("score", 9))
