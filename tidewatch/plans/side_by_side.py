"""Calls of one task side by side, with a deadline for each."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from queue import Empty, Full, Queue
from threading import Event, Lock, Thread
from time import monotonic
from typing import Any

# How often a call that can't hand over its rows looks whether it was given up.
LOOK_SECONDS = 0.1

_NO_MORE = object()

# Calls that were given up and still run in this worker, by group and name.
_late: dict[tuple[str, Any], Thread] = {}
_late_lock = Lock()


class _Call:
    """One call in a thread of its own, which hands its parts to a queue of limited length."""

    def __init__(self, name: str, work: Callable[[str], Iterator[Any]], answers: Queue, seconds: float | None):
        self.name, self.given_up = name, Event()
        self.end = None if seconds is None else monotonic() + seconds
        self._work, self._answers = work, answers
        self.thread = Thread(target=self._run, daemon=True)
        self.thread.start()

    def is_late(self) -> bool:
        return self.end is not None and monotonic() > self.end

    def _hand_over(self, part: Any, error: BaseException | None, last: bool) -> None:
        while not self.given_up.is_set():
            try:
                return self._answers.put((self, part, error, last), timeout=LOOK_SECONDS)
            except Full:
                continue

    def _run(self) -> None:
        try:
            for part in self._work(self.name):
                self._hand_over(part, None, False)
                if self.given_up.is_set():
                    return
            self._hand_over(None, None, True)
        except BaseException as error:
            self._hand_over(None, error, True)


def side_by_side(
    group: str, names: Iterator[str], work: Callable[[str], Iterator[Any]], at_once: int, seconds: float | None
) -> Iterator[Any]:
    """What ``work(name)`` yields for every name, ``at_once`` calls at a time, in no set order.

    A call whose parts have not all been taken after ``seconds`` is given up: what it yields from then on is dropped.
    Its thread can't be stopped, so it is left behind, and no other call of its group and name begins in this worker
    while it runs.  An error of a call that was not given up is raised.  A name that is being called is not called
    a second time at once.
    """
    answers: Queue = Queue(maxsize=2 * at_once)
    running: dict[Any, _Call] = {}
    more = True
    try:
        while True:
            while more and len(running) < at_once:
                name = next(names, _NO_MORE)
                more = name is not _NO_MORE
                if more and name not in running and not _still_late(group, name):
                    running[name] = _Call(name, work, answers, seconds)
            if not running:
                return
            try:
                call, part, error, last = answers.get(timeout=_wait(running))
            except Empty:
                for call in [c for c in running.values() if c.is_late()]:
                    _give_up(group, running.pop(call.name))
                continue
            if call.given_up.is_set():
                continue
            if error is not None:
                raise error
            if last:
                del running[call.name]
            elif call.is_late():
                _give_up(group, running.pop(call.name))
            else:
                yield part
    finally:
        for call in running.values():
            _give_up(group, call)


def _wait(running: dict[str, _Call]) -> float | None:
    """Seconds until the first running call is late; nothing to wait for if there is no deadline."""
    ends = [call.end for call in running.values() if call.end is not None]
    return max(0.001, min(ends) - monotonic() + 0.001) if ends else None


def _give_up(group: str, call: _Call) -> None:
    call.given_up.set()
    with _late_lock:
        _late[group, call.name] = call.thread


def _still_late(group: str, name: str) -> bool:
    with _late_lock:
        for known in [n for n, thread in _late.items() if not thread.is_alive()]:
            del _late[known]
        return (group, name) in _late
