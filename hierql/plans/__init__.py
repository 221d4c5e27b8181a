"""Query front end: text to logical plan, in plain Python."""
