"""Types with codecs, predicates on text, and JSON and array functions."""
