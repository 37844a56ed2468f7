"""Column functions: text, URLs, numbers, dates, redaction."""
