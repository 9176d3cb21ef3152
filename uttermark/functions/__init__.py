"""Column functions: text cleaning, number folding, word alignment costs."""
