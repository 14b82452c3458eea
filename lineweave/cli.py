"""Command line: sort, verify, generate. Everything is said on standard error.

    python -m lineweave sort INPUT OUTPUT [--temp DIR] [--memory 1GiB] [--max-line 64KiB]
                             [--parallelism N] [--pipeline akka|channels]
    python -m lineweave verify INPUT OUTPUT [--max-line 64KiB]
    python -m lineweave generate OUTPUT --size SIZE [--seed N] [--duplicate-ratio R]

``--memory`` is planned with, and refused if too small, but Spark's own settings bound its memory;
``--pipeline`` is accepted, as Spark has one scheduler.
"""

from __future__ import annotations

import os
import shutil
import signal
import sys
import tempfile
import threading
import time
from collections.abc import Callable
from contextlib import contextmanager

from lineweave.functions.sizes import describe_size, parse_size
from lineweave.plans.resources import MAX_ARRAY, disk_decision, least_budget, mean_for, plan_memory

#: Exit codes, fixed by the contract.
OK, MALFORMED, NO_SPACE, USAGE, NOT_VERIFIED, IO_FAILURE, CANCELLED = 0, 1, 2, 3, 4, 5, 130
DEFAULT_MEMORY, DEFAULT_MAX_LINE = 1 << 30, 64 << 10
CEILINGS = {"sort": MAX_ARRAY - 3, "verify": MAX_ARRAY - (4 << 20)}


class UsageError(ValueError):
    pass


class NoSpace(OSError):
    pass


def say(text: str) -> None:
    print(text, file=sys.stderr, flush=True)


def split_arguments(args: list[str], options: dict[str, Callable[[str], object]], paths: int) -> tuple[list[str], dict[str, object]]:
    """Positional paths and converted options; a converter raises UsageError."""
    found: list[str] = []
    values: dict[str, object] = {}
    rest = iter(args)
    for arg in rest:
        if arg in options:
            value = next(rest, None)
            if value is None:
                raise UsageError(f"Nothing follows {arg}.")
            values[arg] = options[arg](value)
        elif arg.startswith("--"):
            raise UsageError(f"There is no option {arg}.")
        elif len(found) == paths:
            raise UsageError(f"'{arg}' is one path too many.")
        else:
            found.append(arg)
    if len(found) < paths or not all(p.strip() for p in found):
        raise UsageError("Say where to write." if paths == 1 else "Say what to read and where to write.")
    return found, values


def _size(name: str, low: int, high: int) -> Callable[[str], int]:
    def convert(text: str) -> int:
        n = parse_size(text)
        if n is None or not low <= n <= high:
            raise UsageError(f"{name}: '{text}' is no size from {low} to {high} bytes (B, KiB, MiB and GiB may follow the digits).")
        return n

    return convert


def _count(text: str) -> int:
    if not (text.isascii() and text.isdigit()) or not 0 < int(text) < 2**31:
        raise UsageError(f"--parallelism: '{text}' is no whole number above 0.")
    return int(text)


def _pipeline(text: str) -> str:
    if text.lower() not in ("akka", "channels"):
        raise UsageError(f"--pipeline: '{text}' is neither akka nor channels.")
    return text.lower()


def _seed(text: str) -> int:
    try:
        n = int(text)
    except ValueError:
        n = 2**31
    if not -(2**31) <= n < 2**31:
        raise UsageError(f"--seed: '{text}' is no whole number of 32 bits.")
    return n


def _ratio(text: str) -> float:
    try:
        r = float(text)
    except ValueError:
        r = -1.0
    if not 0 <= r <= 1:
        raise UsageError(f"--duplicate-ratio: '{text}' is not from 0 to 1.")
    return r


def sort_options(args: list[str]) -> tuple[str, str, dict[str, object]]:
    options = {
        "--temp": str, "--memory": _size("--memory", 1, 2**63 - 1), "--max-line": _size("--max-line", 1, CEILINGS["sort"]),
        "--parallelism": _count, "--pipeline": _pipeline,
    }
    (source, target), values = split_arguments(args, options, 2)
    if os.path.abspath(source) == os.path.abspath(target) or os.path.realpath(source) == os.path.realpath(target):
        raise UsageError("The sort would overwrite what it reads.")
    return source, target, values


def preflight(source: str | None, target: str | None, temp: str | None = None) -> None:
    """Raises UsageError unless the input can be read and the folders written."""
    if source is not None:
        try:
            with open(source, "rb"):
                pass
        except OSError as e:
            raise UsageError(f"No reading from '{source}': {e.strerror}") from e
    for folder in filter(None, (target and os.path.dirname(os.path.abspath(target)), temp)):
        try:
            if folder == temp:
                os.makedirs(folder, exist_ok=True)
            with tempfile.TemporaryFile(dir=folder):
                pass
        except OSError as e:
            raise UsageError(f"No writing into '{folder}': {e.strerror}") from e


def check_space(source: str, target: str, temp: str) -> None:
    """Raises NoSpace if a volume is too small. One device is one volume."""
    size, out = os.path.getsize(source), os.path.dirname(os.path.abspath(target))
    kinds = [("same", temp)] if os.stat(temp).st_dev == os.stat(out).st_dev else [("temp", temp), ("output", out)]
    for kind, folder in kinds:
        try:
            free: int | None = shutil.disk_usage(folder).free
        except OSError:
            free = None
        outcome, required, available = disk_decision(kind, size, free)
        if outcome == "Insufficient":
            raise NoSpace(f"'{folder}' ({kind}) lacks space: {describe_size(required)} wanted, {describe_size(available)} free.")
        if outcome == "Unknown":
            say(f"How much space '{folder}' has is unknown.")


@contextmanager
def cancellable(spark):
    """The first interrupt cancels Spark's jobs; a second one ends the process."""

    def cancel(signum, frame):
        signal.signal(signum, signal.SIG_DFL)
        spark.sparkContext.cancelAllJobs()
        raise KeyboardInterrupt

    old = {s: signal.signal(s, cancel) for s in (signal.SIGINT, signal.SIGTERM)}
    try:
        yield
    finally:
        for s, handler in old.items():
            signal.signal(s, handler)


@contextmanager
def reported(spark, every: float = 2.0):
    """Says how far Spark's active stages are, every few seconds, and wires the signals."""
    over = threading.Event()

    def report():
        tracker = spark.sparkContext.statusTracker()
        while not over.wait(every):
            stages = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))]
            if stages:
                say("  " + ", ".join(f"stage {i.stageId}: {i.numCompletedTasks} of {i.numTasks} tasks" for i in stages))

    thread = threading.Thread(target=report, daemon=True)
    thread.start()
    try:
        with cancellable(spark):
            yield
    finally:
        over.set()
        thread.join()


def run_sort(args: list[str], spark=None) -> int:
    from lineweave.operators.progress import last_stage, merge_summary
    from lineweave.operators.sort_file import sort_file
    from lineweave.session import session

    source, target, values = sort_options(args)
    temp = values.get("--temp") or os.path.dirname(os.path.abspath(target))
    max_line, cores = values.get("--max-line", DEFAULT_MAX_LINE), values.get("--parallelism", os.cpu_count() or 1)
    budget = values.get("--memory", DEFAULT_MEMORY)
    preflight(source, None)
    if plan_memory(budget, cores, max_line, mean_for(max_line)) is None:
        least = least_budget(cores, max_line)
        raise UsageError(f"No plan fits into {budget} bytes; --memory {least} would do." if least else "No --memory is enough for such lines and parallelism.")
    preflight(None, target, temp)
    check_space(source, target, temp)
    began = time.monotonic()
    spark = spark or session("sort")
    with reported(spark):
        size = sort_file(spark, f"file://{os.path.abspath(source)}", target, temp, max_line, told=lambda parts: say(merge_summary(parts, last_stage(spark))))
    say(f"Sorted {describe_size(size)} in {time.monotonic() - began:.1f}s.")
    return OK


def run_verify(args: list[str], spark=None) -> int:
    from lineweave.operators.verify import verify_file
    from lineweave.session import session

    (source, target), values = split_arguments(args, {"--max-line": _size("--max-line", 1, CEILINGS["verify"])}, 2)
    preflight(source, None)
    preflight(target, None)
    spark = spark or session("verify")
    with reported(spark):
        verdict = verify_file(spark, *(f"file://{os.path.abspath(p)}" for p in (source, target)), values.get("--max-line", DEFAULT_MAX_LINE))
    for name, report in (("input: ", verdict.input), ("output:", verdict.output)):
        say(f"  {name} {report.lines} lines, {describe_size(report.bytes)}, hash {report.hash:016x}")
    say(verdict.detail or "verified")
    return OK if verdict.outcome == "Verified" else NOT_VERIFIED


def run_generate(args: list[str], spark=None) -> int:
    from lineweave.operators.generate import Options, sized
    from lineweave.session import session
    from lineweave.sources.sink import publish

    options = {"--size": _size("--size", 0, 2**63 - 1), "--seed": _seed, "--duplicate-ratio": _ratio}
    (target,), values = split_arguments(args, options, 1)
    if "--size" not in values:
        raise UsageError("Say how much with --size.")
    preflight(None, target)
    spark = spark or session("generate")
    with reported(spark):
        lines = sized(spark, Options(values["--size"], values.get("--seed", 0), values.get("--duplicate-ratio", 0.1)))
        size = publish(lines, target, os.path.dirname(os.path.abspath(target)))
    say(f"Generated {describe_size(size)}.")
    return OK


COMMANDS = {"sort": run_sort, "verify": run_verify, "generate": run_generate}


def main(args: list[str], spark=None) -> int:
    """Runs a command and maps what went wrong to its exit code."""
    from lineweave.operators.malformed import MalformedLine
    from lineweave.sources.sink import PublishError

    if not args or args[0] in ("--help", "-h"):
        say(__doc__ or "")
        return OK if args else USAGE
    name, rest = ("verify", args[1:]) if args[0] == "--verify" else (args[0], args[1:])
    try:
        if name not in COMMANDS:
            raise UsageError(f"'{name}' is no command.")
        return COMMANDS[name](rest, spark)
    except UsageError as e:
        say(f"{e}\n\n{__doc__}")
        return USAGE
    except PublishError as e:
        say(f"The result could not be placed: {e}")
        return USAGE
    except MalformedLine as e:
        say(str(e))
        return MALFORMED
    except NoSpace as e:
        say(str(e))
        return NO_SPACE
    except KeyboardInterrupt:
        say("Cancelled.")
        return CANCELLED
    except OSError as e:
        say(f"I/O error: {e}")
        return IO_FAILURE
