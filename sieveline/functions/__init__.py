"""Column functions: text, numbers, rendering."""
