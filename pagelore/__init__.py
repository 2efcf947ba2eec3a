"""A Spark-native engine for libraries of slide decks: index, search, compare, recompose."""
