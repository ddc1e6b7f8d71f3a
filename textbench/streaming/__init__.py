"""textbench.streaming."""
