"""Column functions: text in, column out, evaluated inside the JVM."""
