"""Operations on training text: packing, linking, de-duplication, scoring, mixing.

Nothing outside this folder imports it.
"""
