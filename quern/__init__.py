"""quern: a text search and text data engine made of Spark DataFrame plans."""
