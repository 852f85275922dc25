"""Pixel kernels: numpy functions and the registry that turns them into Arrow operators."""

from benchloom.kernels.registry import apply_kernel, kernels, register

__all__ = ["apply_kernel", "kernels", "register"]
