"""Forest-inventory point analytics as composable Spark DataFrame functions."""
