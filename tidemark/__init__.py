"""Spark-native audit analytics for labelled URL corpora and the classifiers trained on them."""
