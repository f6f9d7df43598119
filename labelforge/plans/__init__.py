"""Named queries: operators bound to the test tables, each with the SQL that states the same result."""
