"""Corpus and answer analytics on Spark DataFrames.

``operators``  table-to-table operators (retrieval, versions, graph, telemetry ...)
``functions``  column expressions and Arrow UDFs
``sources``    record sources and sinks
``streaming``  Structured Streaming jobs
``plans``      named queries over the test tables, each with its SQL counterpart
"""
