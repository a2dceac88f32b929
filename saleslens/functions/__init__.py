"""Column functions: Column in, Column out, built-in expressions only."""
