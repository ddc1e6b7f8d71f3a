"""textbench.operators."""
