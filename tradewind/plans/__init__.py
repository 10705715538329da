"""Reports and jobs assembled from operators."""
