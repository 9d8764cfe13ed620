"""Boolean plans over n-grams."""
