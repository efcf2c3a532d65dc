"""Named queries of the engine and the SQL they are checked against."""
