"""Sources: export files, JSON documents, SQL databases."""
