"""Spark-native analytics for groups of predictive models and for the sensor and text data behind them."""
