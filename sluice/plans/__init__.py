"""Declarations: nodes, their computations, and the plan made of them."""
