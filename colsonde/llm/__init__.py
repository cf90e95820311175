"""Operators for building text corpora at scale.

Nothing outside this subpackage imports it. Shared rules for every operator:

* a null text is an empty text, and empty tables give empty results of the same schema;
* extra columns of the input are ignored by the digest queries and carried by the
  operators, whose own helper columns have names with a ``__`` prefix that no caller uses;
* a row is a document: repeated rows are separate documents unless a docstring says more;
* intermediate tables go to the folder that ``spark.checkpoint.dir`` names, never to a
  machine's own disk, so that a lost executor costs a retry and nothing else.
"""
