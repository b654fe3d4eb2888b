"""corpusmill: text-corpus analytics as composable PySpark DataFrame operators."""
