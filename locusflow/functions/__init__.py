"""Column functions over alignment records; all run inside the JVM."""
