"""Texts that every operator must take."""

#: Nulls, empty, blank and long texts, ties, repeats, odd characters.
ODD = [None, "", " \n\t", "a", "a", "x" * 30000, "word " * 5000, "é😀 ünï <|endoftext|> ​\x85", "same text here. And more!", "same text here. And more!"]
