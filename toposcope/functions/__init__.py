"""Column expressions: they add no job, no shuffle and no state of their own."""
