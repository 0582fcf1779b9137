"""quarry: a Spark-native engine for preparing, auditing and scoring document and chart corpora."""
