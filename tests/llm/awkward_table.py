"""Rows that test the corners."""

LONG = "The quick brown fox, number 1; jumps over the lazy dog. " * 3000


def awkward_rows():
    """(doc_id, text): NULLs, empty and very long texts, ties, repeated rows, repeated and missing ids."""
    junk = "\n".join(["*** $$$ ||| ### &&&"] * 30)
    prose = " ".join(f"word{i} stands here." for i in range(80))
    return [
        (1, prose),
        (2, prose),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, LONG),
        (7, junk),
        (7, prose + " Released under the MIT License. All rights reserved."),
        (8, "cc by cc BY general PUBLIC license"),
        (8, "cc by cc BY general PUBLIC license"),
        (None, "no id but words"),
        (None, None),
        (9, "Größe ÄRGER Σίσυφος İstanbul K 中文 😀"),
        (10, "a"),
        (11, "same line\nsame line\n\nother line\nsame line"),
        (12, "x y z x y z x y z"),
    ]
