"""Column-level building blocks (JVM expressions only, no Python UDFs)."""
