"""Plan building blocks shared by several operators."""
