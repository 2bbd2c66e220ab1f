"""Column expressions shared by operators and plans."""
