"""Every operator as a query over the given tables, beside the SQL that must give the same rows."""
