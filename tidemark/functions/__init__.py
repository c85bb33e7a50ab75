"""Scalar functions."""

from .scalar import register

__all__ = ["register"]
