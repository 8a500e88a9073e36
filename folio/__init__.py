"""folio: long-form text, script, timing and ledger analytics as Spark jobs."""
