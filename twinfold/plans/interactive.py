"""Scripted choices of keepers: what a user's answers mean, as a pure function."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

#: Fixed value: answers that may be wrong in a row before a group is skipped.
MOST_WRONG = 3


def choose(groups: Iterable[tuple[object, list[str]]], answers: Iterable[str]) -> Iterator[tuple[object, str | None]]:
    """(key, path to keep or None to skip) of each (key, members in keeper order).

    Answers: a number names a member, `a` keeps the first member of this and all later groups, `s` skips the group, `q`
    stops. After the last answer, or after `q`, groups are skipped."""
    script = iter(answers)
    always = stopped = False
    for key, members in groups:
        kept = None
        wrong = 0
        while not always and not stopped and wrong < MOST_WRONG:
            answer = next(script, None)
            if answer is None or (said := answer.strip().lower()) == "q":
                stopped = True
            elif said == "a":
                always = True
            elif said == "s":
                break
            elif said.isascii() and said.isdigit() and 1 <= int(said) <= len(members):
                kept = members[int(said) - 1]
                break
            else:
                wrong += 1
        yield key, members[0] if always and not stopped else kept
