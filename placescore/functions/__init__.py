"""Column-expression helpers (``expr``) and text expressions (``text``)."""
