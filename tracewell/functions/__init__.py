"""Features of provenance, similarity between queries, and classifiers of templates."""
