"""Gold models, experiment statistics and the data-quality suite."""
