"""Training-data operators: counting, filtering, deduplication, mixing and sharding of document tables.

Every operator takes and returns DataFrames. Tables have the columns of ``documents``
(doc_id, text, lang, source, n_chars) unless an operator says otherwise; other columns are ignored
by the digest queries and kept by the filters. ``queries`` holds the registered queries.
"""
