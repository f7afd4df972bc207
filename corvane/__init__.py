"""Spark-native analytics for corpora of generated knowledge artefacts and their judgements."""
