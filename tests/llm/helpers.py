"""Shared by the tests of this folder."""

#: Columns that an operator might use for itself.
CLASHES = ("id", "score", "key", "bucket", "text_hash", "d", "t", "n", "owner", "label", "kept", "component_id", "spans", "spans_", "gone_id", "lang_pred", "rejected", "found", "sha", "units", "ranges", "base", "core", "held", "window", "pos")


def rows_of(df, *columns):
    """Rows in an order of their own."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
