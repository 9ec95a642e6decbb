"""Scalar functions as Columns, and the kernels that SQL cannot express."""
