"""Column-to-column helpers that stay inside the JVM."""
