"""corvane: structural analytics over large text and source corpora, on Spark."""
