"""Column functions: numeric, date and text."""
