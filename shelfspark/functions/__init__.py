"""Column functions: text, URLs, HTML, query strings."""
