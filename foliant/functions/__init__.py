"""Column functions shared by the operators. All of them are built-in Spark expressions."""
