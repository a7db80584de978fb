"""Named query plans and the SQL that states the same result."""
