"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; the driver entry adds its queries
only when the subpackage is present.
"""
