"""Brand-sentiment analytics as Spark DataFrame jobs.

``functions``  column expressions and the two Arrow-batched text helpers
``operators``  DataFrame -> DataFrame building blocks
``sources``    table, CSV and JSON readers and writers
``plans``      composite jobs (ingest, reports, review round, model benchmark)
``streaming``  the recurring run as a Structured Streaming job
"""

__version__ = "0.1.0"
