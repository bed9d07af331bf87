"""Column expressions shared by the jobs (no actions, no joins)."""
