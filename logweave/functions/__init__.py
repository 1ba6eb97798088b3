"""Column-level functions: severity, parsing, normalisation, SimHash."""
