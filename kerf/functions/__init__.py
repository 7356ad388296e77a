"""Column expressions over texts and point arrays."""
