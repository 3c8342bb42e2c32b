"""Spark-native analytics over corpora of typeset documents."""
