"""Queries put together from the operators, and models on top of them."""
