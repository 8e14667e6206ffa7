"""Operators for preparing training text at scale.

Every operator takes a DataFrame of documents and the names of its id and text
columns, reads only those two columns, and returns new rows keyed by the id.
Further columns, also such that are named like internal ones, are not read.
Shared conventions, which the operators refer to:

* a null text is an empty text;
* an id may be null; rows with a null id are one document;
* rows that repeat an id with another text are rows of the same document; each is
  treated on its own and returned on its own.
"""
