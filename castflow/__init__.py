"""PySpark jobs that turn podcast feeds into reviewed episodes, transcripts and notes."""
