"""Column functions, all of built-in expressions but for those in ``udfs``."""
