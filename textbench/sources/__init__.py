"""textbench.sources."""
