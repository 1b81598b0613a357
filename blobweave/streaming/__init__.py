"""Features of images that arrive in micro-batches."""
