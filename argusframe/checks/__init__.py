"""Independent SQL statements the queries are compared with."""
