"""Spark-native building blocks for traffic datasets: sampling, encoding, fidelity, compliance."""
