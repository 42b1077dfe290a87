"""Splitters as table functions: the lines of one text come in as a partition, numbered pieces come out.

    NumberedItems(lines.asTable().partitionBy("doc_id").orderBy("place"))

A task holds the text of one partition.  Which heads count is decided over the whole text, by the ordered folds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.functions import udtf

from .ordered import longest_non_decreasing, longest_run_of_ones

# Heads of items, questions, solutions and sections, and the numbers that they may have
ITEM = re.compile(r"(?:^|\n)\s*(?:\[문항\s*([0-9]{1,3})\]|\[해설\s*([0-9]{1,3})\]|([0-9]{1,3})\s*[.)]|([0-9]{1,3})\s*번\s)")
QUESTION = re.compile(r"(?:(?:^|\n)\s*|(?<=[\s　])(?<![0-9.]))(?:\(?\s*([0-9]{1,2})\s*[.)]|([0-9]{1,2})\s*번\s)\s*(?:\[\s*([0-9]+)\s*점\s*\])?", re.M)
SOLUTION = re.compile(r"\[해설\s*([0-9]{1,3})\]")
SECTION = re.compile(r"(?:^|\n)\s*(?:\[정답\s*및\s*해설\]|\[해설\]|정답\s*및\s*해설|해설)\s*\n", re.M)
ANSWER = re.compile(r"\[정답\]\s*([^\n]+)")
MOST_ITEMS, MOST_QUESTIONS, LEAST_PAIRS = 100, 50, 2


def _between(text: str, heads: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """(number, piece) of heads (number, start, end): what lies between a head and the next one."""
    starts = [start for _, start, _ in heads] + [len(text)]
    return [(number, text[end:upto].strip()) for (number, _, end), upto in zip(heads, starts[1:], strict=True)]


def numbered_items(text: str) -> list[tuple[int, str]]:
    """Items by their heads, of which a longest non-decreasing run of numbers counts."""
    found = [(int(next(g for g in m.groups() if g)), m.start(), m.end()) for m in ITEM.finditer(text)]
    found = [h for h in found if 0 < h[0] <= MOST_ITEMS]
    return _between(text, [found[i] for i in longest_non_decreasing([h[0] for h in found])])


def marked_solutions(text: str) -> list[tuple[int, str]]:
    """Solutions by the marks that name their numbers, wherever these stand."""
    found = [(int(m[1]), m.start(), m.end()) for m in SOLUTION.finditer(text)]
    return _between(text, [h for h in found if 0 < h[0] <= MOST_ITEMS])


def questions(text: str) -> list[tuple[int, int | None, str]]:
    """(number, points, content) by heads, of which a longest run of numbers that go up by one counts; empty ones are left out."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", re.sub(r"\r\n?", "\n", text)))
    found = []
    for m in QUESTION.finditer(text):
        number = int(m[1] or m[2])
        if 1 <= number <= MOST_QUESTIONS:
            blank = len(m[0]) - len(m[0].lstrip())
            found.append((number, m.start() + blank, m.end(), int(m[3]) if m[3] else None))
    chosen = [found[i] for i in longest_run_of_ones([h[0] for h in found])] if found else []
    return [(n, h[3], piece) for h, (n, piece) in zip(chosen, _between(text, [h[:3] for h in chosen]), strict=True) if piece]


def solved_problems(text: str) -> list[tuple[int, str, str, str]]:
    """(number, question, solution, answer): items before the solutions' section with those in it, or with marked ones.

    Of several solutions of a number the longest counts, the first of equals.  Fewer than two items give none.
    """
    section = SECTION.search(text)
    problems = numbered_items(text[: section.start()] if section else text)
    if len(problems) < LEAST_PAIRS:
        return []
    best: dict[int, str] = {}
    after = text[section.end() :] if section else ""
    for number, piece in numbered_items(after) if after else marked_solutions(text):
        if len(piece) > len(best.get(number, "")):
            best[number] = piece
    answers = {number: ANSWER.search(piece) for number, piece in best.items()}
    return [(n, piece, best.get(n, ""), answers[n][1].strip() if answers.get(n) else "") for n, piece in problems]


class _Text:
    """Collects the lines of a partition: rows (doc_id, place, text), null texts as empty ones."""

    def __init__(self) -> None:
        self.doc_id, self.lines = None, []

    def eval(self, row: Row) -> None:
        self.doc_id = row[0]
        self.lines.append(row[2] or "")


@udtf(returnType="doc_id bigint, place int, number int, piece string")
class NumberedItems(_Text):
    def terminate(self) -> Iterator[tuple]:
        for i, item in enumerate(numbered_items("\n".join(self.lines))):
            yield self.doc_id, i, *item


@udtf(returnType="doc_id bigint, place int, number int, points int, content string")
class Questions(_Text):
    def terminate(self) -> Iterator[tuple]:
        for i, question in enumerate(questions("\n".join(self.lines))):
            yield self.doc_id, i, *question


@udtf(returnType="doc_id bigint, place int, number int, question string, solution string, answer string")
class SolvedProblems(_Text):
    def terminate(self) -> Iterator[tuple]:
        for i, pair in enumerate(solved_problems("\n".join(self.lines))):
            yield self.doc_id, i, *pair
