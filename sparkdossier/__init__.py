"""Case-document analytics on Spark: relational operators over document tables."""
