"""Analytics operators: DataFrame in, DataFrame out."""
