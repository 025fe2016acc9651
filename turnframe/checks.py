"""V-1 .. V-5: parameter and data checks.

Every parameter has its limits in one table; all that are out of their
limits are named in one error, before any Spark work.
"""

from __future__ import annotations

#: Least number of turns or steps each setting allows.
LEAST = {"chunk_turns": 2, "prompt_turns": 1, "stride": 1, "min_turns": 2}


class DatasetError(ValueError):
    """Settings or data from which no dataset can be built."""


def _raise(problems: list[str]) -> None:
    if problems:
        raise DatasetError("; ".join(problems))


def check_settings(val_ratio: float, test_ratio: float, **turns: int) -> None:
    """Ratios and the turn settings of ``LEAST``."""
    problems = [f"{name} is {value}, the least is {LEAST[name]}" for name, value in turns.items() if value < LEAST[name]]
    held = {"val_ratio": val_ratio, "test_ratio": test_ratio}
    problems += [f"{name} is {value}, below 0" for name, value in held.items() if value < 0]
    if sum(held.values()) >= 1:
        problems.append(f"val_ratio and test_ratio add up to {sum(held.values())}, so nothing is left to train on")
    if turns.get("prompt_turns", 0) >= turns.get("chunk_turns", float("inf")):
        problems.append("a prompt as long as its chunk leaves no turn to complete")
    _raise(problems)


def check_sizes(turns: int, examples: int, train: int | None = None) -> None:
    """There has to be a turn, an example and a training example."""
    if not turns:
        _raise(["the input has no usable turn"])
    if not examples:
        _raise([f"{turns} turns give no example with these settings"])
    if train is not None and train < 1:
        _raise([f"of {examples} examples the ratios leave {train} to train on"])
