"""Readers and writers: driver tables, the fact table, raw extracts, sinks."""
from .tables import read_table, fact_from_tables, fact_table, materialize_fact
from .extracts import read_csv_extract, read_json_extract, ingest
from .sinks import append_new_rows, read_fact, write_fact

__all__ = [
    "read_table", "fact_from_tables", "fact_table", "materialize_fact",
    "read_csv_extract", "read_json_extract", "ingest",
    "append_new_rows", "read_fact", "write_fact",
]
