"""Column functions on text: native expressions where Spark has them, Arrow functions where it has not."""
