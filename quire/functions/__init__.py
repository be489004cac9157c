"""Column expressions (all JVM-side, whole-stage-codegen friendly)."""
