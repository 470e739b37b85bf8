"""A PySpark-native engine for narrow queries over tables, documents, text, graphs and event ledgers."""
