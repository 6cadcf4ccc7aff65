"""Column functions: text analysis and matching, and their SQL registration."""
