"""Reading tables, entity views over them, and writing results."""
