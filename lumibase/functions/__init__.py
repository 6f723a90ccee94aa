"""Column expressions: origin rules, dates, paths and measures. Each takes and returns Columns."""
