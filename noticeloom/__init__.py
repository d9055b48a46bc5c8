"""Noticeloom: document facts and training-corpus preparation on Spark."""
