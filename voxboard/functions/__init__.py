"""Column expressions: text, dates, ids, privacy and keyword scores."""
