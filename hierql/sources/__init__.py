"""Event stores from files and tables, and writers of results."""
