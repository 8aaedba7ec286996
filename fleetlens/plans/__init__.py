"""Query plans: every operator bound to its inputs, with a check in SQL."""
