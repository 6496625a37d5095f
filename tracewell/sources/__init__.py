"""Tables: fixed schemas, loading, provenance tokens, and a star schema derived from the driver's tables."""
