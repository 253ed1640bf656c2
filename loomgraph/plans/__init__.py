"""From query text to DataFrames: parser, scope and emission."""
