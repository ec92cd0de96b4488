"""Declared schemas of the stored tables; nothing is inferred. Later versions back-fill what older files lack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENTS = "id string, source_filename string, status string, page_count int, created_at timestamp, updated_at timestamp"
PAGES = "id string, document_id string, page_number int, raw_image_path string, preprocessed_image_path string, created_at timestamp, updated_at timestamp"
BLOCK = "struct<start_offset:int,end_offset:int,score:double,method:string>"
REVISIONS = f"id string, page_id string, revision int, content_markdown string, origin string, model_name string, is_validated boolean, bulk_validated boolean, created_at timestamp, confidence_blocks array<{BLOCK}>"
JOBS = "id string, document_id string, kind string, status string, queue_id string, error string, created_at timestamp, updated_at timestamp"
CHUNKS = "chunk_id string, document_id string, page_number int, content string, embedding array<float>"

TABLES = {"documents": DOCUMENTS, "pages": PAGES, "revisions": REVISIONS, "jobs": JOBS, "chunks": CHUNKS}
#: What a column holds in files written before it existed.
BACKFILL = {"bulk_validated": False, "status": "new"}


def schema(name: str) -> StructType:
    return StructType.fromDDL(TABLES[name])


def migrated(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns of the table, missing ones back-filled (a default, or null)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(BACKFILL.get(f.name))).cast(f.dataType).alias(f.name) for f in schema(name)])
