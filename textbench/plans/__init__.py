"""textbench.plans."""
