"""Small helpers around queries: arguments, paths, observed values, guards, logging, and a grammar over tokens."""

from __future__ import annotations

import argparse
import dataclasses
import logging
import sys
from collections.abc import Callable, Iterable, Sequence
from enum import Enum, IntFlag
from pathlib import Path
from typing import Any, Generic, TypeVar

T = TypeVar("T")


class Watched(Generic[T]):
    """A value whose watchers are called with it when it changes."""

    def __init__(self, value: T):
        self._value, self._watchers = value, []

    @property
    def value(self) -> T:
        return self._value

    @value.setter
    def value(self, new: T) -> None:
        if new != self._value:
            self._value = new
            for w in list(self._watchers):
                w(new)

    def __add__(self, watcher: Callable[[T], object]) -> Watched[T]:
        self._watchers.append(watcher)
        return self

    def __sub__(self, watcher: Callable[[T], object]) -> Watched[T]:
        self._watchers.remove(watcher)
        return self


@dataclasses.dataclass(frozen=True)
class Requirement:
    name: str
    short: str = ""
    help: str = ""
    default: str | None = None
    mandatory: bool = False


def check_arguments(requirements: Iterable[Requirement], args: Sequence[str]) -> dict[str, str | None]:
    """Values by name; argparse prints help or the fault and exits."""
    parser = argparse.ArgumentParser()
    for r in requirements:
        names = ([f"-{r.short}"] if r.short else []) + [f"--{r.name}"]
        parser.add_argument(*names, help=r.help, default=r.default, required=r.mandatory)
    return vars(parser.parse_args(list(args)))


def configure(config: type[T], args: Sequence[str]) -> T:
    """A dataclass filled from --name value arguments, by its fields' defaults and types."""
    parser = argparse.ArgumentParser()
    for f in dataclasses.fields(config):
        needed = f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING
        kind = {"int": int, "float": float, "bool": lambda x: x.lower() in ("1", "true", "yes")}.get(getattr(f.type, "__name__", f.type), str)
        parser.add_argument(f"--{f.name}", type=kind, required=needed, default=argparse.SUPPRESS)
    return config(**vars(parser.parse_args(list(args))))


class PathStatus(Enum):
    FILE = "file"
    FOLDER = "folder"
    MISSING_FILE = "missing file"
    MISSING_PATH = "missing path"


class FilePath:
    def __init__(self, path: str | Path):
        self.path = Path(path)

    @property
    def status(self) -> PathStatus:
        if self.path.is_dir():
            return PathStatus.FOLDER
        if self.path.is_file():
            return PathStatus.FILE
        return PathStatus.MISSING_FILE if self.path.parent.is_dir() else PathStatus.MISSING_PATH

    @property
    def name(self) -> str:
        return self.path.name

    def up(self, levels: int = 1) -> FilePath:
        p = self.path
        for _ in range(levels):
            p = p.parent
        return FilePath(p)

    def is_well_formed(self) -> bool:
        return bool(self.path.name) and "\0" not in str(self.path)

    def rename(self, to: str | Callable[[str], str], overwrite: bool = False) -> FilePath:
        """A suffix to the name, or a function of it."""
        target = self.path.with_name(to(self.path.name) if callable(to) else self.path.name + to)
        if target.exists() and not overwrite:
            raise FileExistsError(target)
        return FilePath(self.path.replace(target))


class Guard:
    @staticmethod
    def not_null(value: T | None, name: str) -> T:
        if value is None:
            raise ValueError(f"{name} is null")
        return value

    @staticmethod
    def in_range(value, low, high, name: str):
        if not low <= value <= high:
            raise ValueError(f"{name} must be from {low} to {high}")
        return value

    @staticmethod
    def not_empty(value, name: str):
        if not value:
            raise ValueError(f"{name} is empty")
        return value


def logger(name: str, level: int = logging.INFO, file: str | None = None, keep: Callable[[logging.LogRecord], bool] | None = None, stream=None) -> logging.Logger:
    """A logger to the console, and to a file if one is named; keep filters its records."""
    out = logging.getLogger(name)
    out.setLevel(level)
    for h in [logging.StreamHandler(stream or sys.stderr), *([logging.FileHandler(file, encoding="utf-8")] if file else [])]:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s"))
        if keep is not None:
            h.addFilter(keep)
        out.addHandler(h)
    return out


class KafkaHandler(logging.Handler):
    """Log lines to a send(topic, bytes) function, such as a producer's."""

    def __init__(self, send: Callable[[str, bytes], object], topic: str):
        super().__init__()
        self.send, self.topic = send, topic

    def emit(self, record: logging.LogRecord) -> None:
        self.send(self.topic, self.format(record).encode())


class Logged(Generic[T]):
    """A value that logs what is done to it."""

    def __init__(self, value: T, log: logging.Logger):
        self.value, self.log = value, log

    def __add__(self, other: Any) -> Logged:
        self.log.info("%r + %r", self.value, other)
        return Logged(self.value + other, self.log)

    def __sub__(self, other: Any) -> Logged:
        self.log.info("%r - %r", self.value, other)
        return Logged(self.value - other, self.log)


class Digestion(IntFlag):
    NONE = 0
    DIGESTED = 2
    COMPLETED = 4
    PROPAGATE = 8


class Terminal:
    """One exact token."""

    def __init__(self, token: str):
        self.token = token

    def ends(self, tokens: Sequence[str], at: int) -> set[int]:
        return {at + 1} if at < len(tokens) and tokens[at] == self.token else set()


class Sequence_:
    """Parts one after the other."""

    def __init__(self, *parts):
        self.parts = parts

    def ends(self, tokens: Sequence[str], at: int) -> set[int]:
        now = {at}
        for p in self.parts:
            now = {e for a in now for e in p.ends(tokens, a)}
        return now


class OneOf:
    """Any of several rules."""

    def __init__(self, *rules):
        self.rules = rules

    def ends(self, tokens: Sequence[str], at: int) -> set[int]:
        return {e for r in self.rules for e in r.ends(tokens, at)}


class TokenMatcher:
    """Feeds tokens one at a time to a rule."""

    def __init__(self, rule):
        self.rule, self.tokens = rule, []

    def accept(self, token: str) -> Digestion:
        if self.rule.ends([*self.tokens, token], 0) & {len(self.tokens) + 1}:
            self.tokens.append(token)
            return Digestion.DIGESTED | Digestion.COMPLETED
        if self._possible([*self.tokens, token]):
            self.tokens.append(token)
            return Digestion.DIGESTED
        return Digestion.NONE

    def _possible(self, tokens: list[str]) -> bool:
        """Whether some continuation could match: a wildcard stands for what is to come."""

        class Open(list):
            def __getitem__(self, i):
                return super().__getitem__(i) if isinstance(i, slice) or i < len(self.known) else ANY

        class Any_(str):
            def __eq__(self, other):
                return True

            __hash__ = str.__hash__

        ANY = Any_("")
        padded = Open([*tokens, *[ANY] * 64])
        padded.known = tokens
        return any(e > len(tokens) for e in self.rule.ends(padded, 0))
