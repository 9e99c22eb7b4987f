"""Column-expression helpers (built-in Spark functions; one Arrow UDF for LCS)."""
