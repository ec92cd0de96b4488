"""Where tables and files come from, and where they go."""
