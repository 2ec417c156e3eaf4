"""reviewlake: a PySpark-native engine for peer-review and document corpora."""
