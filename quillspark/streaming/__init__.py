"""quillspark.streaming"""
