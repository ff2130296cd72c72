"""Scalar functions of the auditor, as Column expressions."""
