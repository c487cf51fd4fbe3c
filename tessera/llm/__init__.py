"""Operators for building training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, keys its work by ``(doc_id, xxhash64(text))`` where rows
have to be found again, and keeps intermediate tables in the shared folder
that ``spark.checkpoint.dir`` names.
"""
