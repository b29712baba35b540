"""Operations of a training-data pipeline over large text tables.

Nothing outside this subpackage imports it.
"""
