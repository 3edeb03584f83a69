"""Push-down style analytics on Spark: scans, filters, aggregations, top-N,
MySQL-flavoured scalar functions, table statistics and change streams."""
