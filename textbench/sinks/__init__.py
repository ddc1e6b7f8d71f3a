"""textbench.sinks."""
