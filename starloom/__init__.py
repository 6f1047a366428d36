"""starloom: sky-survey tables, images and text corpora as Spark DataFrames."""
