"""DataFrame -> DataFrame operators: cleaning, alignment, gaps, lags, splits, quality, scoring."""
