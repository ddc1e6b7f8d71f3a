"""textbench.functions."""
