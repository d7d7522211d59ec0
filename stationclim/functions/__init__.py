"""Column-expression builders (JVM-side functions only)."""
