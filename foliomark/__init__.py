"""Turn decoded document tables into Markdown documents with PySpark.

The package takes tables of pages, positioned blocks, table cells, slide shapes,
OCR lines and image references and builds one Markdown document and one report
row per input file.  Every operator is ``DataFrame -> DataFrame`` or
``Column -> Column`` on built-in Spark expressions.
"""
