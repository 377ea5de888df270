"""Column functions: text, identity and numeric kernels."""
