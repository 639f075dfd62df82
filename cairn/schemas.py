"""Table schemas and row expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USERS = "id long, name string, dob date, username string, email string, contact_no string, user_type string, created_at timestamp"
DOCUMENTS = "id long, document_name string, uploaded_at timestamp, uploaded_by long, size_bytes long, file_type string, mime_type string, status string, storage_path string, error_message string, processing_started_at timestamp, metrics variant"
BLOCK = "struct<block_type:string,content:string,page_number:int,heading_level:int>"
CHUNKS = "id long, document_id long, chunk_index int, content string, embedding array<float>, page_number int, metadata struct<section_heading:string,page_number:int,page_end:int,token_count:int,char_count:int,has_list:boolean,is_continuation:boolean,document_id:long,chunk_index:int>, created_at timestamp"
JOBS = "document_id long, storage_path string, file_type string, uploaded_at_ms long"

# What the stored columns may hold.
FILE_TYPES = ("JPG", "JPEG", "PNG", "PDF", "DOCX", "TXT")
STATUSES = ("pending", "processing", "completed", "failed")
LIMITS = {"name": (1, 150), "username": (3, 50), "password": (8, 200), "email": (1, 254), "contact_no": (0, 20)}
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def document_expectations() -> dict[str, Column]:
    """True where a document row is sound; null counts as unsound for the enumerations."""
    return {
        "size_ok": F.coalesce(F.col("size_bytes") >= 0, F.lit(True)),
        "file_type_ok": F.coalesce(F.col("file_type").isin(*FILE_TYPES), F.lit(False)),
        "status_ok": F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
    }


def registration_errors(df: DataFrame) -> Column:
    """Names of the fields out of their limits or form; optional ones may be null."""
    checks = []
    for name, (low, high) in LIMITS.items():
        if name in df.columns:
            bad = ~F.char_length(F.col(name)).between(low, high)
            bad = F.coalesce(bad, F.lit(name != "contact_no"))
            if name == "email":
                bad = bad | ~F.coalesce(F.col(name).rlike(EMAIL), F.lit(False))
            checks.append(F.when(bad, F.lit(name)))
    if "dob" in df.columns:
        checks.append(F.when(F.expr("try_to_date(CAST(dob AS STRING), 'yyyy-MM-dd') IS NULL"), F.lit("dob")))
    return F.array_compact(F.array(*checks))


def orphans(children: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    known = parents.select(F.col(parent_key).alias(key))
    return children.where(F.col(key).isNotNull()).join(known, key, "left_anti")


def new_users(candidates: DataFrame, users: DataFrame) -> DataFrame:
    """Candidates whose username and email are both free (duplicates are turned away).

    Of candidates in one batch that share either, one stays; another of them may
    come again with the next batch.
    """
    free = candidates.join(users.select("username"), "username", "left_anti")
    free = free.join(users.select("email"), "email", "left_anti")
    return free.dropDuplicates(["username"]).dropDuplicates(["email"])
