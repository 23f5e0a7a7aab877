"""Time limits for single rows in Python workers."""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")


class _Late(BaseException):
    """Not an Exception, so that a row's own handlers do not swallow it."""


def within(f: Callable[[], T], seconds: float) -> tuple[T | None, bool]:
    """f() and whether it took too long, in which case it is stopped and the result is None.

    Works by the process's alarm, in the main thread of a worker; elsewhere f runs without a limit.
    """
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        return f(), False

    def ring(*_) -> None:
        raise _Late

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        return f(), False
    except _Late:
        return None, True
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
