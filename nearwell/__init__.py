"""nearwell: clean, geo-validate, search and verify a directory of care facilities on Spark."""
