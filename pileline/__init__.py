"""A PySpark-native engine for variant calling, ordered sequences and columnar codecs."""
