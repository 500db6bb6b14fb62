"""speechloom: curation of speech-to-text datasets, and of text corpora, as Spark DataFrame transformations."""
