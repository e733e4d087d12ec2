"""Column functions: dates, numbers and text."""
