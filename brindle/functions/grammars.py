"""Pretokenizer grammars: how a text is cut into pieces before merging.

A grammar is one regular expression; the pieces of a text are its successive leftmost matches. The patterns are those that
published tokenizers carry, so that they must equal them to the letter. Spark's (Java's) regex engine reads them as they are
under the flag (?U), which makes \\s and case folding follow Unicode.
"""

from __future__ import annotations

# Published pretokenizer patterns.
CL100K = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""
CL100K_IMPORTED = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
LLAMA3 = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
QWEN = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
O200K = r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+(?i:'s|'t|'re|'ve|'m|'ll|'d)?|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*(?i:'s|'t|'re|'ve|'m|'ll|'d)?|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
TEKKEN = r"""[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]*[\p{Ll}\p{Lm}\p{Lo}\p{M}]+|[^\r\n\p{L}\p{N}]?[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}]+[\p{Ll}\p{Lm}\p{Lo}\p{M}]*|\p{N}| ?[^\s\p{L}\p{N}]+[\r\n/]*|\s*[\r\n]+|\s+(?!\S)|\s+"""

#: Name to pattern. cl100k and cl100k_imported differ in white space at the end of a text, so they are two grammars.
GRAMMARS = {"cl100k": CL100K, "cl100k_imported": CL100K_IMPORTED, "llama3": LLAMA3, "qwen": QWEN, "o200k": O200K, "tekken": TEKKEN}


def classify(pattern: str) -> str | None:
    """The grammar whose pattern this is, to the letter."""
    return next((name for name, known in GRAMMARS.items() if known == pattern), None)


def java_pattern(grammar: str) -> str:
    """The pattern for Spark's regex functions."""
    if grammar not in GRAMMARS:
        raise KeyError(f"no grammar {grammar!r}; there are {', '.join(GRAMMARS)}")
    # Java's $ also matches before a final line break, where \z does not
    return "(?U)" + GRAMMARS[grammar].replace("$", r"\z")
