"""MySQL-flavoured scalar and aggregate functions as Column expressions."""
