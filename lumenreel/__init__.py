"""Content analytics for clips, transcripts, trends and text corpora as Spark DataFrame operators."""
