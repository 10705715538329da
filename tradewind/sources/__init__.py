"""Where rows come from and go to: messages, Parquet warehouse, JDBC, fixtures."""
