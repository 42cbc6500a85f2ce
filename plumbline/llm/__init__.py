"""Operators for preparing training text.  Nothing else in the library imports this package.

Conventions shared by all of them:

* a word is a maximal run of characters outside space and U+0009 to U+000D;
* null text is the empty text;
* inputs may carry any further columns; only the named ones are read, so clashing names do no harm;
* tables that are used twice are written below ``spark.checkpoint.dir`` (see ``scratch``), never to a
  folder of one machine.
"""
