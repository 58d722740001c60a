"""Work on episodes, states, transcripts and notes: DataFrame in, DataFrame out."""
