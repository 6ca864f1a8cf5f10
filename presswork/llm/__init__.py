"""Training-data operators: one module per operator, `queries` names them.

Conventions that hold for all of them:

* words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased, which is
  exactly `bytes.lower().split()` on its UTF-8 form;
* a null text counts as empty; a row without an id cannot be named in a result
  and takes no part (filters of whole documents let it pass);
* extra columns are carried only by operators that return documents, and no
  operator depends on the names of columns it did not ask for.
"""
