"""Job-posting analytics on Spark: normalisation, quality, search, audits, usage reports and merges."""
