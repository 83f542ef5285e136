"""Record layouts, declared once. They need no session."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, DOUBLE, BOOLEAN, TIME = T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
STRINGS, DOUBLES = T.ArrayType(STRING), T.ArrayType(DOUBLE)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


DOCUMENT = _struct(doc_id=STRING, source_path=STRING, title=STRING, num_pages=INT, file_hash=STRING, ingested_at=TIME)
PAGE = _struct(doc_id=STRING, page_number=INT, text=STRING, tables=STRINGS, headings=STRINGS, char_count=INT, text_quality=DOUBLE)
BLOCK = _struct(doc_id=STRING, page_number=INT, page_width=DOUBLE, page_height=DOUBLE, x0=DOUBLE, y0=DOUBLE, x1=DOUBLE, y1=DOUBLE, text=STRING, font_sizes=DOUBLES, has_bold_span=BOOLEAN)
GRID = _struct(doc_id=STRING, page_number=INT, grid=T.ArrayType(STRINGS))
WARNING = _struct(page_number=INT, kind=STRING, message=STRING)
CHUNK = _struct(chunk_id=STRING, doc_id=STRING, text=STRING, chunk_type=STRING, page_start=INT, page_end=INT, section_heading=STRING, subheading=STRING, token_count=INT, text_quality=DOUBLE, chunk_index=INT)
PAYLOAD = _struct(chunk_id=STRING, doc_id=STRING, source_file=STRING, page_start=INT, page_end=INT, section_heading=STRING, subheading=STRING, chunk_type=STRING, text=STRING, token_count=INT, text_quality=DOUBLE, embedding_model=STRING)
POINT = _struct(id=STRING, vector=T.ArrayType(T.FloatType()), payload=PAYLOAD)
HIT = _struct(query_id=STRING, chunk_id=STRING, doc_id=STRING, source_file=STRING, page_start=INT, page_end=INT, section_heading=STRING, subheading=STRING, chunk_type=STRING, text=STRING, score=DOUBLE, rank=INT, retriever=STRING)
GOLD = _struct(query_id=STRING, query=STRING, relevant_chunk_ids=STRINGS, note=STRING)
EVIDENCE_RESPONSE = _struct(status=STRING, selections=T.ArrayType(_struct(evidence_id=STRING, quote=STRING)))
