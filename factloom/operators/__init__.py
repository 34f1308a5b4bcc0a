"""The relation API: named-column sets and their algebra."""
