"""quillmill: searchable archives of conversations, notes and versioned documents on Spark."""
