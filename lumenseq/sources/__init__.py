"""Text formats of sequences, overlaps, alignments and reports.

A `read_*` function reads files through Spark; the `parse_*` function under it takes any DataFrame of
lines or records, so that the text may come from elsewhere. `ord` numbers the rows in file order.
"""
