"""Column functions: string in, column out, all built from JVM expressions."""
