"""Column expressions. Nothing in here starts a job or leaves the JVM."""
