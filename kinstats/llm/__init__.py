"""Operations for building training corpora: filters, de-duplication, packing and archives.

Nothing outside this subpackage imports it.
"""
