"""maskwell: document privacy analytics as DataFrame transforms on Spark."""
