"""quillspark: retrieval analytics and document processing on Spark DataFrames."""
