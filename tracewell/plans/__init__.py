"""Report templates, their parameters, and batch execution."""
