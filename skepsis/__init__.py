"""Spark-native toolkit that asks whether an apparent signal is real or an artifact."""
