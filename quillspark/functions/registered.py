"""The Python-backed functions under SQL names, for ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

PREFIX = "qs_"


def register(spark: SparkSession) -> list[str]:
    """Register the functions in the session; the names registered."""
    from quillspark.functions.markup import parse_document
    from quillspark.operators import convert, edits, importer, similarity, verse

    found = {
        "parse": parse_document,
        "render": convert.render_document,
        "convert": importer.import_page,
        "notes": importer.harvest_notes,
        "capitals": convert.folded_capitals,
        "markdown": convert.markdown_html,
        "nodes": edits.html_nodes,
        "edit": edits.edited,
        "first_json": edits.first_json,
        "unnest_anchors": edits.unnested,
        "similarity": similarity.ratio_of,
        "fold_marks": similarity.folded,
        "verse": verse.split_verse,
    }
    for name, function in found.items():
        spark.udf.register(PREFIX + name, function)
    return [PREFIX + n for n in found]
