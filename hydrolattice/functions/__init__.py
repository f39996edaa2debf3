"""Column expressions: pure, JVM-side, no UDF."""
