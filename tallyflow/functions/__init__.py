"""Column expressions (no shuffles, all JVM-side)."""
