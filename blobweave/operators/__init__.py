"""Building regions, and selecting, scoring and classifying them."""
