"""Exported event documents as rows, one for each element.

A document may be larger than a split.  The text reader is given the closing tag as its line
separator, so a file is cut into read ranges like any other, each element is read by the task
in whose range it starts, and none is lost or doubled at a border.  The same holds for a stream
of files, whose offsets the checkpoint keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _elements(text: Column, element: str) -> Column:
    """The elements in the text up to one closing tag: empty ones, and at most one with content.

    Comments are passed over.  Attribute values may hold any character.
    """
    plain = F.regexp_replace(text, r"(?s)<!--.*?-->", "")
    attributes = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
    found = F.regexp_extract_all(plain, F.lit(rf"(?s)<{element}(?=[\s/>]){attributes}(?:(?<=/)>|>.*)"), F.lit(0))
    # the closing tag was the separator; empty elements have none, and neither has a cut-off last one
    return F.transform(found, lambda x: F.when(x.rlike(rf"^<{element}(?=[\s/]){attributes}(?<=/)>$"), x).otherwise(F.concat(x, F.lit(f"</{element}>"))))


def event_documents(spark: SparkSession, path: str, *, element: str = "event", stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """(document, file, partition columns of the folder): every element of the documents below ``path``.

    ``path`` may be a folder, a file or a pattern.  What stands between elements, such as the tags of
    an outer document, is dropped; files without elements give no rows.  A closing tag inside a comment
    or a CDATA section of an element is not told from a real one, and neither are elements inside an
    element of the same name; exported events have neither.  A last element without its closing tag gives
    a document that is not well formed, so that shredding reports it instead of hiding it.
    """
    reader = spark.readStream if stream else spark.read
    if files_per_trigger and stream:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.option("lineSep", f"</{element}>").text(path)
    rest = [c for c in lines.columns if c != "value"]
    rows = lines.select(F.explode(_elements(F.col("value"), element)).alias("document"), F.col("_metadata.file_path").alias("file"), *rest)
    return rows


def named_events(documents: DataFrame) -> DataFrame:
    """Event documents with the columns that ``error_event_shred`` asks for: the name and the document."""
    name = F.regexp_extract("document", r"""^<event\b[^>]*?\sname=["']([^"']*)""", 1)
    return documents.withColumns({"object_name": F.nullif(name, F.lit("")), "event_data": F.col("document")})
