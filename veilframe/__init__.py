"""A data-policy engine on Spark: who may see which rows, and how each column looks to them."""
