"""Column expressions: cleaning rules, scales, inference and text measures."""
