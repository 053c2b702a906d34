"""Extension points: user scorers, answer parsers by task type, and
per-step callbacks.

User code runs inside Spark tasks over Arrow batches (``mapInPandas``);
step hooks see whole runs (rows hash-partitioned by run and sorted by step).
Nothing is brought to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from runlens.operators import messages as M

# ── scorers ────────────────────────────────────────────────────────────────

SCORE_SCHEMA = [
    T.StructField("status", T.StringType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("details", T.StringType()),
]

Scorer = Callable[[dict[str, Any], dict[str, Any]], dict[str, Any]]


def apply_scorer(pairs: DataFrame, scorer: Scorer, instance_cols: list[str], prediction_cols: list[str],
                 keys: list[str]) -> DataFrame:
    """Run ``scorer(instance, prediction) -> {accepted, score?, details?}``
    on every (instance, prediction) row.  An exception becomes a row with
    ``status = 'error'`` and the message in ``details``, as the report does
    with a failing evaluation."""
    schema = T.StructType([pairs.schema[k] for k in keys] + SCORE_SCHEMA)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                inst = {c: rec.get(c) for c in instance_cols}
                pred = {c: rec.get(c) for c in prediction_cols}
                row = {k: rec[k] for k in keys}
                try:
                    res = scorer(inst, pred) or {}
                    acc = bool(res.get("accepted", False))
                    row.update(status=res.get("status") or ("passed" if acc else "failed"), accepted=acc,
                               score=float(res.get("score", 1.0 if acc else 0.0)),
                               details=None if res.get("details") is None else str(res.get("details")))
                except Exception as exc:  # noqa: BLE001
                    row.update(status="error", accepted=False, score=0.0, details=f"{type(exc).__name__}: {exc}")
                out.append(row)
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

    cols = list(dict.fromkeys(keys + instance_cols + prediction_cols))
    return pairs.select(*cols).mapInPandas(run, schema)


# ── answer parsers ─────────────────────────────────────────────────────────

AnswerParser = Callable[[Column], Column]

ANSWER_PARSERS: dict[str, AnswerParser] = {}


def register_answer_parser(name: str, parser: AnswerParser | None = None):
    """Register a column-level parser ``params_json -> answer`` under a
    finish-tool name; usable as a decorator."""
    def add(fn: AnswerParser) -> AnswerParser:
        ANSWER_PARSERS[name] = fn
        return fn

    return add(parser) if parser is not None else add


def _param(params: Column, field: str) -> Column:
    return F.try_variant_get(F.try_parse_json(params), f"$.{field}", "string")


register_answer_parser("default", lambda p: F.lit(None).cast("string"))
register_answer_parser("submit_int", lambda p: M.answers_int(p).cast("string"))
register_answer_parser("file_fl", lambda p: F.array_join(M.answers_files(_param(p, "files")), "\n"))
register_answer_parser("submit_file", lambda p: M.answers_path(_param(p, "file_path")))


def parse_answer(kind: Column, params: Column) -> Column:
    """Dispatch on the finish-tool name with one CASE over the registry (all
    branches are JVM expressions); unknown names give NULL."""
    expr = None
    for name, fn in ANSWER_PARSERS.items():
        expr = F.when(kind == name, fn(params)) if expr is None else expr.when(kind == name, fn(params))
    return expr if expr is not None else F.lit(None).cast("string")


# ── answer parsers that give rows ──────────────────────────────────────────

RowParser = Callable[[str], Iterable[tuple]]

ROW_PARSERS: dict[str, tuple[RowParser, T.StructType]] = {}


def register_row_parser(name: str, schema: T.StructType, parser: RowParser | None = None):
    """Register a parser ``params_json -> rows`` of ``schema`` under a
    finish-tool name; usable as a decorator.  Call ``register_answer_rows``
    afterwards: the SQL function takes the parsers that are known then."""
    def add(fn: RowParser) -> RowParser:
        ROW_PARSERS[name] = (fn, schema)
        return fn

    return add(parser) if parser is not None else add


def _text_param(params: str, name: str) -> str:
    value = json.loads(params)[name]
    if not isinstance(value, str):
        raise TypeError(f"{name} is not text")
    return value


@register_row_parser("file_fl", T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("file", T.StringType())]))
def file_rows(params: str) -> Iterable[tuple]:
    """The entries of a newline list, by their place."""
    return enumerate(x.strip() for x in _text_param(params, "files").split("\n") if x.strip())


def _column_value(kind: T.DataType):
    """Python value -> value that a column of ``kind`` takes as it is."""
    def whole(v):
        if int(v) != v:
            raise TypeError(f"{v!r} is not a whole number")
        return int(v)

    take = float if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else whole if isinstance(kind, T.IntegralType) else (
        lambda v: v.item() if hasattr(v, "item") else v)
    return lambda v: None if v is None else take(v)


def register_answer_rows(spark: SparkSession, name: str = "answer_rows") -> None:
    """Register the table function ``answer_rows(kind, params_json)`` for SQL
    and lateral joins.  ``kind`` is a literal: its parser's schema is the
    function's.  A parser that fails gives no rows, as a finish tool whose
    parameters cannot be read has no answer.

    The function is a plain one: an Arrow table function builds and casts a
    frame for each of its calls, one per row of a lateral join."""
    parsers = dict(ROW_PARSERS)
    takes = {kind: [_column_value(f.dataType) for f in schema.fields] for kind, (_, schema) in parsers.items()}

    class AnswerRows:
        @staticmethod
        def analyze(kind: AnalyzeArgument, params: AnalyzeArgument) -> AnalyzeResult:
            if not kind.isConstantExpression or kind.value not in parsers:
                raise ValueError(f"the first argument must be one of {sorted(parsers)}")
            return AnalyzeResult(schema=parsers[kind.value][1])

        def eval(self, kind: str, params: str) -> Iterator[tuple]:
            try:
                rows = [tuple(r) for r in parsers[kind][0](params)] if params is not None else []
            except Exception:  # noqa: BLE001
                return
            take = takes[kind]
            for row in rows:
                yield tuple(f(v) for f, v in zip(take, row, strict=True))

    spark.udtf.register(name, udtf(AnswerRows, useArrow=False))


# ── step hooks ─────────────────────────────────────────────────────────────

StepHook = Callable[[pd.DataFrame], pd.DataFrame]


def run_step_hooks(steps: DataFrame, hook: StepHook, schema: str | T.StructType, run: str = "run_id",
                   step: str = "step", per_run: bool = True, unnamed: str = "run") -> DataFrame:
    """Call ``hook`` with each run's steps in step order.

    Rows are hash-partitioned by run and sorted by ``(run, step)`` inside each
    partition; the pieces of a run that straddles Arrow batches are put together
    once, so a run is never split.  ``per_run=True`` calls the hook once per run;
    ``per_run=False`` hands it whole batches of complete runs (sorted), for
    hooks written with vectorised ``groupby`` logic.  Either way there is no
    Python round trip per group (a run is bounded by ``max_steps``).

    Steps without a run id are one run with ``unnamed="run"``, which is for
    tables that hold few of them; with ``unnamed="step"`` each is a run of its
    own, dealt over all tasks, and the hook is called with that one row."""
    if unnamed not in ("run", "step"):
        raise ValueError(f"unnamed must be 'run' or 'step', not {unnamed!r}")
    keys = [F.col(run)]
    if unnamed == "step":
        keys.append(F.when(F.col(run).isNull(), F.xxhash64(*steps.columns)))
    ordered = steps.repartition(*keys).sortWithinPartitions(run, step)

    def called(done: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if unnamed == "step":
            alone = done[run].isna()
            for i in range(int(alone.sum())):
                yield hook(done[alone].iloc[i : i + 1].reset_index(drop=True))
            done = done[~alone]
        if done.empty:
            return
        if per_run:
            for _, g in done.groupby(run, sort=False, dropna=False):
                yield hook(g.reset_index(drop=True))
        else:
            yield hook(done.reset_index(drop=True))

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_run: list[pd.DataFrame] = []  # pieces of the run that may go on in the next batch
        for pdf in batches:
            if pdf.empty:
                continue
            last = pdf[run].iloc[-1]
            tail = pdf[run].isna() if pd.isna(last) else pdf[run] == last
            if unnamed == "step" and pd.isna(last):
                tail[:] = False  # each of these steps is complete
            if open_run:
                held = open_run[0][run].iloc[0]
                same = pdf[run].isna() if pd.isna(held) else pdf[run] == held
                if same.all() and tail.all():
                    open_run.append(pdf)
                    continue
                yield from called(pd.concat([*open_run, pdf[same]], ignore_index=True))
                pdf, tail, open_run = pdf[~same], tail[~same], []
            if not pdf[~tail].empty:
                yield from called(pdf[~tail])
            if tail.any():
                open_run = [pdf[tail]]
        if open_run:
            yield from called(pd.concat(open_run, ignore_index=True))

    return ordered.mapInPandas(per_partition, schema)


#: ``(memo, step) -> (memo, output columns or None)``: a callback that sees the
#: steps of a run one by one; the memo (any JSON value, ``None`` at the start of
#: a run) is what it remembers of the run
StepFold = Callable[[Any, dict[str, Any]], tuple[Any, dict[str, Any] | None]]


def fold_hook(fold: StepFold, columns: list[str], run: str = "run_id", step: str = "step") -> StepHook:
    """The hook for ``run_step_hooks(per_run=True)`` that gives one run's steps
    to ``fold``, with the rows that ``stream_step_hooks`` gives: ``run``, ``step``
    and ``columns``."""
    def hook(pdf: pd.DataFrame) -> pd.DataFrame:
        memo, out = None, []
        for rec in pdf.to_dict("records"):
            memo, found = fold(memo, {k: v for k, v in rec.items() if k != run})
            if found is not None:
                out.append((rec[run], rec[step], *[found.get(c) for c in columns]))
        return pd.DataFrame(out, columns=[run, step, *columns])

    return hook
