"""Driver-side plans: matrices, runs, agents."""
