"""Time limits for functions that score rows in a Python worker: by a signal, or by a process that can be ended."""

from __future__ import annotations

import functools
import multiprocessing
import os
import signal
import threading
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import functions as F


def time_limit(seconds: float) -> Callable:
    """Decorator: a call that takes longer raises TimeoutError.

    The limit is a timer signal, so it works in a process's main thread, where workers run their functions; in another
    thread it is an error rather than no limit.  Pure C calls are interrupted when they return."""

    def put(fn: Callable) -> Callable:
        @functools.wraps(fn)
        def limited(*args, **kwargs):
            if threading.current_thread() is not threading.main_thread():
                raise RuntimeError("a time limit needs the main thread")

            def stop(signum, frame):
                raise TimeoutError(f"{fn.__name__} took more than {seconds} s")

            before = signal.signal(signal.SIGALRM, stop)
            signal.setitimer(signal.ITIMER_REAL, seconds)
            try:
                return fn(*args, **kwargs)
            finally:
                signal.setitimer(signal.ITIMER_REAL, 0)
                signal.signal(signal.SIGALRM, before)

        return limited

    return put


def _serve(fn: Callable, rows: list, wrong, out) -> None:
    """The helper's work: one answer a row, in order, each sent once it is there."""
    signal.signal(signal.SIGTERM, signal.SIG_DFL)
    try:
        for row in rows:
            try:
                out.send(wrong if any(x is None for x in row) else fn(*row))
            except Exception:  # a scorer never fails its batch
                out.send(wrong)
    finally:
        os._exit(0)


def limited_map(fn: Callable, rows: Iterable[tuple], wrong, seconds: float) -> list:
    """``fn`` of every row; ``wrong`` for rows that hold a null, fail, or take more than ``seconds``.

    The rows go to a forked helper process, which answers row by row.  One that is late is killed, whatever it is
    doing (a call into C as well), and another helper goes on with the next row, so the limit holds in any thread
    and costs the other rows of the batch nothing."""
    rows, fork, out = list(rows), multiprocessing.get_context("fork"), []
    while len(out) < len(rows):
        ours, theirs = fork.Pipe(duplex=False)
        helper = fork.Process(target=_serve, args=(fn, rows[len(out) :], wrong, theirs), daemon=True)
        helper.start()
        theirs.close()
        try:
            while len(out) < len(rows) and ours.poll(seconds):
                out.append(ours.recv())
            if len(out) < len(rows):  # late
                out.append(wrong)
        except EOFError:  # the helper died of this row
            out.append(wrong)
        finally:
            helper.kill()
            helper.join()
            ours.close()
    return out


def limited_udf(fn: Callable, kind, wrong, seconds: float):
    """A column function from a Python scorer of two values, with :func:`limited_map` over each Arrow batch."""

    @F.pandas_udf(kind)
    def score_(given: pd.Series, truth: pd.Series) -> pd.Series:
        return pd.Series(limited_map(fn, zip(given, truth, strict=True), wrong, seconds), dtype=object)

    return score_
