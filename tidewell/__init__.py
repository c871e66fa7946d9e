"""tidewell: content analytics on Spark.

functions   column functions: dates, URLs, text, tags, HTML
operators   DataFrame operators: filters, joins, aggregates, ordering, writes, retrieval, judging
sources     schemas, table adapters, readers and the paged archive data source
plans       composed queries (browse, search, report, export) and the query catalogue
streaming   work queue, ledger, breaker, milestones and windows on Structured Streaming
llm         training-data operators (optional; nothing here imports it)
"""
