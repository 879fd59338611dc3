"""Spark-native analytics for team-sport and fantasy-league decision support."""
