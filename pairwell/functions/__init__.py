"""Column functions: text cleaning, URL keys, encodings, scores."""
