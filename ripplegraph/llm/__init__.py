"""Operators for preparing language-model training data.

Nothing outside this folder imports it (the entry module adds its queries only
when it is there).  Conventions shared by all operators: null text counts as
empty text, only the named columns of the input are read (other columns, also
ones that clash with output names, are ignored), and an empty table gives an
empty result of the same schema.
"""
