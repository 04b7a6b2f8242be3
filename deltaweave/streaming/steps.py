"""Patching while steps arrive: Structured Streaming over step rows.

A step row (see :func:`deltaweave.operators.pairs.find_steps`) can be applied
when all steps before it were.  The state of a stream is the number of steps
applied and the end of its output; steps that come early wait in the state, with
their old stream once for all of them and only while there are some.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions.codecs import unpack_zero_runs
from ..functions.kernels import as_array

OUTPUT = "stream_id long, step_no long, out_pos long, bytes binary"
STATE = "next_step long, made long, old binary, waiting binary"


def apply_step(old: np.ndarray, covers: bytes, run_code: bytes, literal: bytes, made: int, last: bool) -> bytes:
    """The output of one step that starts at place ``made`` of the new stream."""
    rows = np.frombuffer(covers, "<i8").reshape(-1, 3).tolist()
    difference = unpack_zero_runs(run_code, sum(n for *_, n in rows))
    out, at, used = [], 0, 0
    for i, j, n in rows:
        if j < made or i < 0 or i + n > len(old) or used + j - made > len(literal):
            raise ValueError("a cover of the step is out of bounds")
        out.append(literal[used : used + j - made])
        out.append((old[i : i + n] + difference[at : at + n]).tobytes())
        used, at, made = used + j - made, at + n, j + n
    tail = literal[used:]
    if tail and not last:
        raise ValueError("literal bytes are left behind the step")
    return b"".join([*out, tail])


def _pack(rows: list[tuple]) -> bytes:
    import pickle

    return pickle.dumps(rows)


def _unpack(data: bytes) -> list[tuple]:
    import pickle

    return pickle.loads(data) if data else []  # noqa: S301  state that this operator wrote


def _run(key: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    following, made, old, waiting = state.get if state.exists else (0, 0, b"", b"")
    old = bytes(old)
    rows = {r[0]: r for r in _unpack(bytes(waiting))}
    for part in parts:
        for r in part.itertuples(index=False):
            if r.step_no >= following:
                rows[r.step_no] = (r.step_no, bytes(r.covers), bytes(r.run_code), bytes(r.literal), bool(r.last))
                old = bytes(r.old)
    out = []
    while following in rows:
        number, covers, code, literal, last = rows.pop(following)
        piece = apply_step(as_array(old), covers, code, literal, made, last)
        out.append((key[0], number, made, piece))
        made, following = made + len(piece), following + 1
    state.update((following, made, old if rows else b"", _pack(sorted(rows.values()))))
    if out:
        yield pd.DataFrame(out, columns=["stream_id", "step_no", "out_pos", "bytes"])


def patch_steps(steps: DataFrame) -> DataFrame:
    """Output segments (stream_id, step_no, out_pos, bytes) of a stream of steps.

    ``steps`` is a streaming DataFrame (stream_id, step_no, old, covers,
    run_code, literal, last); steps may come in any order, repeated steps are
    ignored, and every segment is put out once, in order.
    """
    return steps.groupBy("stream_id").applyInPandasWithState(_run, OUTPUT, STATE, "append", "NoTimeout")
