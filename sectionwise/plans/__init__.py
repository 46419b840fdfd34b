"""Driver queries and their reference SQL."""
