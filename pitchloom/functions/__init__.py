"""Column expressions: pitch arithmetic, text formatting, fixed-length vectors."""
