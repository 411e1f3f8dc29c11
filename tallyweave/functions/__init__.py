"""Column functions, all JVM side."""
