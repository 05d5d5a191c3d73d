"""Tuples through external programs, as streams of lines."""

from __future__ import annotations

import logging
import subprocess
import threading
import time
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.text import parse_kv

log = logging.getLogger(__name__)
#: Lines of one Arrow batch given back, and lines of a program's complaints that an error quotes.
LINES, QUOTED = 4096, 20


def streamed(command: list[str], lines: Iterable[str], timeout: float | None = None) -> Iterator[str]:
    """Lines that a program writes while it is given ``lines``.

    A thread feeds the program as fast as it reads, so neither side is ever held whole: what
    waits is in the two pipes. Complaints are logged as they come. A program that fails, or
    neither takes a line nor gives one for ``timeout`` seconds, raises an error that quotes the
    last of them; one that stops reading early and ends well is fine. It never outlives the iterator.
    """
    process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
    complaints: deque[str] = deque(maxlen=QUOTED)
    broken: list[BaseException] = []
    moved, late = [time.monotonic()], threading.Event()

    def feed() -> None:
        try:
            for line in lines:
                process.stdin.write(line.encode() + b"\n")
                moved[0] = time.monotonic()
        except BrokenPipeError:
            pass
        except BaseException as error:  # noqa: BLE001  raised again where lines are read
            broken.append(error)
            process.kill()
        finally:
            try:
                process.stdin.close()
            except OSError:
                pass

    def listen() -> None:
        for line in process.stderr:
            complaints.append(line.decode(errors="replace").rstrip("\n"))
            log.warning("%s: %s", command[0], complaints[-1])

    def watch() -> None:
        while process.poll() is None:
            if time.monotonic() - moved[0] > timeout:
                late.set()
                process.kill()
                return
            time.sleep(min(0.05, timeout / 4))

    threads = [threading.Thread(target=f, daemon=True) for f in (feed, listen, *([watch] if timeout else []))]
    for thread in threads:
        thread.start()
    try:
        for line in process.stdout:
            moved[0] = time.monotonic()
            yield line.decode().removesuffix("\n")
        process.wait()
        for thread in threads:
            thread.join()
        if broken:
            raise broken[0]
        quoted = "".join(f"\n{c}" for c in complaints)
        if late.is_set():
            raise TimeoutError(f"{command[0]} did nothing for {timeout} seconds{quoted}")
        if process.returncode:
            raise RuntimeError(f"{command[0]} ended with {process.returncode}{quoted}")
    finally:
        process.kill()
        process.wait()


def external(df: DataFrame, command: list[str], timeout: float | None = None, per_tuple: bool = False) -> DataFrame:
    """Tuples through a program: ``key TAB value`` lines in, any number of lines out.

    One process serves a whole partition, so what it keeps lasts over all of it; partition by a
    key first if it counts by one. A line without a tab then has an empty key; empty lines are left
    out. With ``per_tuple`` each tuple has a process of its own and such a line keeps the tuple's
    key. A null value goes in as an empty text; a program is started for partitions with tuples only.
    """

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        for batch in batches:
            yield from zip((k or "" for k in batch.column("key").to_pylist()), (v or "" for v in batch.column("value").to_pylist()))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
        tuples = given(batches)
        if per_tuple:
            for k, v in tuples:
                yield from ((k, line) for line in streamed(command, [f"{k}\t{v}"], timeout))
        elif (first := next(tuples, None)) is not None:
            lines = (f"{k}\t{v}" for part in ([first], tuples) for k, v in part)
            yield from (("", line) for line in streamed(command, lines, timeout))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([h[i] for h in held], pa.string()) for i in range(2)], ["own", "line"])
        for own, line in found(batches):
            if line:
                held.append((own, line))
            if len(held) == LINES:
                yield batch()
                held = []
        if held:
            yield batch()

    lines = df.select("key", "value").mapInArrow(run, "own string, line string")
    key, value = parse_kv("line", "own")
    return lines.select(key.alias("key"), value.alias("value"))
