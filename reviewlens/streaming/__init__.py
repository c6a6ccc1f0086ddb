"""The same measures over a stream of reviews or chat turns."""
