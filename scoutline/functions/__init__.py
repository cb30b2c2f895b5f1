"""Column -> Column functions (all JVM-side except ``nfkd``)."""
