"""assay: review and triage of large tables on Spark."""
