"""Column expressions over text: windows, ids, prompts and name handling."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import fixed_values as fixed


def fixed_windows(
    text: Column, size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP
) -> Column:
    """Overlapping windows of ``size`` characters as an array; null or '' gives no window.

    One regular expression walks the text once: the lookahead captures the whole
    window, the match itself advances by ``size - overlap``. Cost is linear in the
    text, unlike a ``substring`` per window, which rescans from the start.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    step = size - overlap
    every_step = F.regexp_extract_all(
        text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)
    )
    # The last steps can lie wholly inside the previous window; they add nothing.
    wanted = F.greatest(F.lit(1), F.ceil((F.length(text) - overlap) / step)).cast("int")
    return F.when(F.length(text) > 0, F.slice(every_step, F.lit(1), wanted)).otherwise(
        F.array().cast("array<string>")
    )


def chunk_id(key: Column, index: Column) -> Column:
    return F.concat(key.cast("string"), F.lit(fixed.CHUNK_ID_INFIX), index.cast("string"))


def short_name(name: Column) -> Column:
    """Last part of a slash-separated name."""
    return F.element_at(F.split(name, "/"), -1)


def render(template: str, **columns: Column) -> Column:
    """Fill ``{name}`` places of a template with columns; null counts as ''.

    Only the given names are replaced, so other braces stay as they are.
    """
    places = "|".join(re.escape("{" + name + "}") for name in columns)
    parts = []
    for piece in re.split(f"({places})", template):
        if piece.startswith("{") and piece[1:-1] in columns:
            parts.append(F.coalesce(columns[piece[1:-1]].cast("string"), F.lit("")))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def short_question_prompt(chunk: Column) -> Column:
    """Prompt over a whole chunk, which is short as it is."""
    return render(fixed.SHORT_QUESTION_PROMPT, excerpt=chunk)


def question_prompt(chunk: Column) -> Column:
    return render(fixed.QUESTION_PROMPT, chunk=chunk)


def answer_prompt(question: Column, context: Column) -> Column:
    return render(fixed.ANSWER_PROMPT, question=question, context=context)


def judge_prompt(question: Column, context: Column, answer: Column) -> Column:
    return render(fixed.JUDGE_PROMPT, question=question, context=context, answer=answer)


def without_prompt(generated: Column, prompt: Column) -> Column:
    """Generated text with an echoed prompt removed, trimmed of surrounding white space."""
    return F.regexp_replace(F.replace(generated, prompt, F.lit("")), r"^\s+|\s+$", "")


def seeded_key(identifier: Column, seed: int = fixed.SAMPLE_SEED) -> Column:
    """Pseudo-random order key that every engine computes alike."""
    return F.md5(F.concat(identifier.cast("string"), F.lit(f":{seed}")))
