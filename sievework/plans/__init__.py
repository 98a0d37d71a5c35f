"""Query catalogue: named queries and the SQL they are checked against."""
