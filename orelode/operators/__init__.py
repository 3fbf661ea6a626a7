"""DataFrame in, DataFrame out: the mining operators."""
