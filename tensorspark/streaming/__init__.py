"""Tensors that arrive in chunks."""
