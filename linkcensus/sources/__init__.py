"""Where tables and watch-lists come from."""
