"""Prompts for a classifier as columns: candidates in sorted order, the diff cut to its limit, notes if there are any."""

from __future__ import annotations

from pyspark.sql import functions as F

from runweave.functions.expr import effective_lines
from runweave.operators.diffs import truncated

SYSTEM = "You sort tests into blocking, recommended and skip for a code change. Answer with JSON only: {\"decisions\": [{\"test_path\", \"classification\", \"confidence\", \"reasoning\"}]}."
AGAIN, ANSWER_SHOWN = "\n\nThis answer was not valid JSON of the agreed form:\n", 500
#: fixed values: a diff beyond the first number of effective lines is described in steps first, beyond the second it is cut
STEPS_ABOVE, CUT_ABOVE = 100, 2000


def prompt(paths: str, diff: str, notes: str | None = None, *, ordered: bool = True) -> F.Column:
    """The question for an array of paths and a diff; the paths in order, or as they stand (for repeated passes)."""
    parts = [F.lit("Tests:\n"), F.array_join(F.sort_array(F.col(paths)) if ordered else F.col(paths), "\n"), F.lit("\n\nChange:\n"), F.coalesce(truncated(diff, CUT_ABOVE), F.lit(""))]
    if notes:
        parts += [F.when(F.length(F.trim(F.coalesce(F.col(notes), F.lit("")))) > 0, F.concat(F.lit("\n\nNotes:\n"), F.col(notes))).otherwise("")]
    return F.concat(*parts)


def retry_prompt(paths: str, diff: str, answer: str, notes: str | None = None) -> F.Column:
    """The question again, with the beginning of the answer that couldn't be read."""
    return F.concat(prompt(paths, diff, notes), F.lit(AGAIN), F.substring(F.coalesce(F.col(answer), F.lit("")), 1, ANSWER_SHOWN))


def in_steps(diff: str) -> F.Column:
    """Whether a diff is large enough to be summarised, then located, then judged."""
    return F.coalesce(effective_lines(diff), F.lit(0)) > STEPS_ABOVE


#: The questions put to a large change one after the other, with what stands for an answer that doesn't come; {0} and {1} are the answers before.
STEPS = (
    ("Change:\n{diff}\n\nWhich files does this change in substance? Answer with a list separated by commas.", "unknown"),
    ("Files:\n{0}\n\nChange:\n{diff}\n\nWhich functions or methods does this change? Answer with a list separated by commas.", "unknown"),
    ("Files:\n{0}\n\nFunctions:\n{1}\n\nChange:\n{diff}\n\nSay in one sentence what behaviour changes.", "the behaviour changes"),
)


def step_context(diff: str, ask) -> tuple[str, int, int]:
    """(what is known of a large change, calls answered, tokens used): each step's answer goes into the questions after it."""
    answers: list[str] = []
    calls = tokens = 0
    for question, otherwise in STEPS:
        found = ask(question.format(*answers, diff=diff))
        if found is not None:
            calls, tokens = calls + 1, tokens + found[1]
        answers.append(found[0].strip() if found and found[0].strip() else otherwise)
    return "Files: {}\nFunctions: {}\nBehaviour: {}".format(*answers), calls, tokens
