"""Column builders: cleaning rules and predicates, all JVM-side expressions."""
