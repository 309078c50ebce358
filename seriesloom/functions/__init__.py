"""Column functions: no data movement, JVM expressions only."""
