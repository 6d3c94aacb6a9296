"""Operations for large text corpora: one module an operator, queries in :mod:`.queries`.

Nothing outside this subpackage imports it.
"""
