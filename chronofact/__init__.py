"""A bi-temporal fact engine and corpus tools on Spark."""
